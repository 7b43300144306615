"""Reading raw process logs and writing result tables, splits, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw log columns (fixed by the input files).
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("processId", T.LongType()),
        T.StructField("threadId", T.LongType()),
        T.StructField("parentProcessId", T.LongType()),
        T.StructField("userId", T.LongType()),
        T.StructField("mountNamespace", T.LongType()),
        T.StructField("processName", T.StringType()),
        T.StructField("hostName", T.StringType()),
        T.StructField("eventId", T.LongType()),
        T.StructField("eventName", T.StringType()),
        T.StructField("stackAddresses", T.StringType()),
        T.StructField("argsNum", T.LongType()),
        T.StructField("returnValue", T.LongType()),
        T.StructField("args", T.StringType()),
        T.StructField("sus", T.IntegerType()),
        T.StructField("evil", T.IntegerType()),
    ]
)


def _by_header(spark: SparkSession, path: str, pattern: str | None) -> list[list[str]]:
    """Files of a path (file, folder or glob) in groups of one header line, which is all that is read of them here."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found = []
    for status in fs.globStatus(where) or []:
        found += list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
    if any(s.isDirectory() for s in found):
        return []  # partition folders: Spark's own listing finds their columns
    groups: dict[str | None, list[str]] = {}
    for status in sorted(found, key=lambda s: s.getPath().toString()):
        file = status.getPath()
        name = file.getName()
        if name[0] in "._" or pattern and not fnmatch(name, pattern) or not status.getLen():
            continue
        stream = fs.open(file)
        codec = codecs.getCodec(file)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        groups.setdefault(lines.readLine(), []).append(file.toString())
        lines.close()
    return list(groups.values())


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, pattern: str | None = None) -> DataFrame:
    """One CSV input (file, folder or glob); columns are matched to the schema by header name.

    The header alone decides which columns a file has, so an input may lack some of them, and files of one folder may have
    different ones or another order: files with one header are one scan, and the scans are united by name.
    """
    def reader():
        plain = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
        return plain.option("pathGlobFilter", pattern) if pattern else plain

    types = {f.name: f.dataType for f in schema or ()}
    out = None
    for files in _by_header(spark, path, pattern) or [path]:
        header = reader().csv(files).columns
        present = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        part = reader().schema(present).csv(files) if header else reader().csv(files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_logs(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Union of several inputs. Missing paths are skipped with a warning; absent columns become null."""
    parts = []
    for path in paths:
        try:
            parts.append(read_csv(spark, path, schema))
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            print(f"warning: skipping missing input {path}")
    if not parts:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def find_inputs(spark: SparkSession, folder: str, pattern: str = "*data.csv") -> DataFrame:
    """Input files of a folder by glob: path and size. The extension may be left off the pattern."""
    glob = pattern if "." in pattern.rsplit("/", 1)[-1] else f"{pattern}.*"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return files.load(folder).select("path", F.col("length").alias("bytes"))


def with_source_file(df: DataFrame, out: str = "source_file") -> DataFrame:
    return df.withColumn(out, F.col("_metadata.file_name"))


def source_profile(df: DataFrame) -> DataFrame:
    """Rows and megabytes per input file, and the total over all files as file ``*``."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("bytes")
    )
    mb = F.round(F.sum("bytes") / 1048576.0, 6).alias("mb")
    total = per_file.agg(F.lit("*").alias("file"), F.sum("n_rows").alias("n_rows"), mb)
    return per_file.groupBy("file").agg(F.sum("n_rows").alias("n_rows"), mb).unionByName(total)


def tag_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Union of named parts with a literal ``split`` column."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def append_rows(df: DataFrame, more: DataFrame) -> DataFrame:
    return df.unionByName(more, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return path


def write_by_split(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Full set laid out by split; the test-only copy is the ``split=test`` folder, read by pruning."""
    df.write.partitionBy("split").format(fmt).save(path)
    return path


def report_lines(stats: DataFrame, name: str = "metric", mean: str = "mean", std: str = "std") -> DataFrame:
    """One text line per metric: right-aligned name, mean and spread with four decimals."""
    line = F.format_string("%15s: mean=%.4f, std=%.4f", F.col(name), F.col(mean), F.col(std))
    return stats.select(line.alias("value"))


def write_report(lines: DataFrame, path: str) -> str:
    lines.write.text(path)
    return path
