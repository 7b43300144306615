"""Shared helpers: Arrow maps over single rows, written intermediate tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddrows.session import scratch_path

# Rows that a Python task turns into objects at a time.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of ``save`` that no later frame reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_arrow(df: DataFrame, inputs: list[str], outputs: T.StructType, make: Callable[[], Callable], rows: int = SLICE_ROWS, raw: bool = False) -> DataFrame:
    """Add columns computed from ``inputs`` row by row, a slice of rows at a time, inside Arrow batches.

    ``make()`` runs once per task and returns a function from lists of input values to lists (or Arrow arrays) of output
    values; with ``raw`` it is given Arrow arrays. A column of the input that has the name of an output is replaced.
    """
    new = [f.name for f in outputs]
    keep = [c for c in df.columns if c not in new]
    needed = unused(df, *[f"in{i}" for i in range(len(inputs))])
    wide = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(n) for c, n in zip(inputs, needed)])
    schema = T.StructType([df.schema[c] for c in keep] + list(outputs))
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                given = part.columns[len(keep) :]
                values = fn(*(given if raw else [c.to_pylist() for c in given]))
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *new])

    return wide.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, from batches sorted by them; one run is held at a time."""
    run: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` by alternating large and small stars.

    Returns ``(node, root)`` for every node that is not the least of its component. Edges stay distributed; each round is
    written to the shared folder. Stars are joined back on their centre, where AQE splits a hot one.
    """

    def oriented(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = save(oriented(edges), "edges")
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = save(oriented(after), "edges")
        found = mark(after)
        discard(now)
        now = after
        if found == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = found


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
