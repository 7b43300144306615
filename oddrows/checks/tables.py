"""Sources and sinks: each query writes with Spark and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.checks.base import logs, on_logs, query, table
from oddrows.operators.profile import mean_std_over_runs
from oddrows.session import scratch_path
from oddrows.sources import logs as src

LOG_COLS = "timestamp, processId, parentProcessId, userId, mountNamespace, processName, hostName, eventId, eventName, argsNum, returnValue, args, sus, evil"
RAW = [c.strip() for c in LOG_COLS.split(",")]


def _csv_copy(spark, sf_dir, name="logs"):
    path = scratch_path(spark, name)
    return src.write_table(logs(spark, sf_dir).select("id", *RAW), path, "csv")


@query("read_logs", on_logs(f"SELECT {LOG_COLS.replace('timestamp', 'round(timestamp, 6) AS timestamp')}, CAST(NULL AS BIGINT) AS threadId FROM logs"))
def read_logs(spark, sf_dir):
    """Two CSV inputs, one without ``args`` columns, and one missing path."""
    full = logs(spark, sf_dir)
    a, b = scratch_path(spark, "even"), scratch_path(spark, "odd")
    src.write_table(full.filter("id % 2 = 0").select(*RAW, F.lit(None).cast("long").alias("threadId")), a, "csv")
    src.write_table(full.filter("id % 2 <> 0").select(*RAW), b, "csv")
    df = src.read_logs(spark, [a, b, a + "-absent"], src.LOG_SCHEMA)
    return df.select(F.round("timestamp", 6).alias("timestamp"), *RAW[1:], "threadId")


@query(
    "read_mixed_folder",
    on_logs(
        "SELECT id, processId, CASE WHEN id % 3 <> 1 THEN userId END AS userId, CASE WHEN id % 3 <> 0 THEN processName END AS processName FROM logs",
    ),
)
def read_mixed_folder(spark, sf_dir):
    """Three files of one folder: other columns, in another order."""
    full, folder = logs(spark, sf_dir), scratch_path(spark, "mixed")
    kept = [["id", "processId", "userId"], ["processName", "processId", "id"], ["userId", "id", "processName", "processId"]]
    for k, cols in enumerate(kept):
        src.write_table(full.filter(F.col("id") % 3 == k).select(*cols), f"{folder}/part{k}", "csv")
    types = T.StructType([T.StructField("id", T.LongType()), *[f for f in src.LOG_SCHEMA if f.name in ("processId", "userId", "processName")]])
    return src.read_csv(spark, f"{folder}/part*", types).select("id", "processId", "userId", "processName")


@query("find_inputs")
def find_inputs(spark, sf_dir):
    found = src.find_inputs(spark, sf_dir, "*s.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes")


@query("with_source_file", "SELECT 'events.parquet' AS source_file, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def with_source_file(spark, sf_dir):
    df = src.with_source_file(table(spark, sf_dir, "events"))
    return df.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("source_file")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "source_profile",
    "SELECT 'events.parquet' AS file, count(*) AS n_rows, 1 AS sized FROM events UNION ALL SELECT 'orders.parquet', count(*), 1 FROM orders"
    " UNION ALL SELECT '*', (SELECT count(*) FROM events) + (SELECT count(*) FROM orders), 1",
)
def source_profile(spark, sf_dir):
    # rows per file are what SQL can tell; that sizes are there is a flag
    out = src.source_profile(spark.read.option("pathGlobFilter", "*s.parquet").parquet(f"{sf_dir}/events.parquet", f"{sf_dir}/orders.parquet"))
    return out.select("file", "n_rows", (F.col("mb") > 0).cast("int").alias("sized"))


@query(
    "tag_splits",
    on_logs(
        "SELECT split, count(*) AS n, CAST(sum(evil) AS BIGINT) AS evil_n FROM (SELECT *, CASE WHEN id % 10 < 6 THEN 'train' WHEN id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM logs) GROUP BY split"
    ),
)
def tag_splits(spark, sf_dir):
    df = logs(spark, sf_dir)
    tagged = src.tag_splits(
        {"train": df.filter("id % 10 < 6"), "validation": df.filter("id % 10 BETWEEN 6 AND 7"), "test": df.filter("id % 10 > 7")}
    )
    return tagged.groupBy("split").agg(F.count("*").alias("n"), F.sum("evil").alias("evil_n"))


@query(
    "append_rows",
    "SELECT o_orderstatus AS status, count(*) AS n, count(o_orderpriority) AS with_priority FROM (SELECT o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT l_linestatus, NULL FROM lineitem) GROUP BY 1",
)
def append_rows(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    more = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("o_orderstatus"))
    both = src.append_rows(first, more)
    return both.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("with_priority"))


@query("write_table", "SELECT * FROM orders")
def write_table(spark, sf_dir):
    path = src.write_table(table(spark, sf_dir, "orders"), scratch_path(spark, "orders"))
    return spark.read.parquet(path)


@query("write_by_split", on_logs("SELECT 'test' AS split, count(*) AS n FROM logs WHERE id % 10 >= 8"))
def write_by_split(spark, sf_dir):
    df = logs(spark, sf_dir)
    tagged = src.tag_splits({"train": df.filter("id % 10 < 8"), "test": df.filter("id % 10 >= 8")})
    path = src.write_by_split(tagged, scratch_path(spark, "splits"))
    return spark.read.parquet(path).filter("split = 'test'").groupBy("split").agg(F.count("*").alias("n"))


HOSTS = "SELECT avg(evil) AS ratio, avg(amount) AS amount FROM logs GROUP BY hostName"


@query(
    "write_report",
    on_logs(
        "SELECT printf('%15s: mean=%.4f, std=%.4f', 'ratio', avg(ratio), stddev_pop(ratio)) AS value FROM h UNION ALL SELECT printf('%15s: mean=%.4f, std=%.4f', 'amount', avg(amount), stddev_pop(amount)) FROM h",
        h=HOSTS,
    ),
)
def write_report(spark, sf_dir):
    runs = logs(spark, sf_dir).groupBy("hostName").agg(F.avg("evil").alias("ratio"), F.avg("amount").alias("amount"))
    wide = mean_std_over_runs(runs, [], ["ratio", "amount"])
    stats = wide.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in ("ratio", "amount")]))
    )
    path = src.write_report(src.report_lines(stats), scratch_path(spark, "report"))
    return spark.read.text(path)
