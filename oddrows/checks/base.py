"""Registry of runnable queries over the given tables, each with its reference SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so sums in a different order compare equal."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(
        *[(F.round(F.col(f"`{f.name}`").cast("double"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema]
    )


# The event table seen as a process log: the same text for both engines, but for the time, JSON and text type.
_LOG_COLUMNS = (
    "event_id AS id",
    "{seconds} AS timestamp",
    "CAST(event_id % 50 AS BIGINT) AS processId",
    "CAST(k % 10 AS BIGINT) AS parentProcessId",
    "CAST(user_id * 10 AS BIGINT) AS userId",
    "CAST(4026531840 + k % 3 AS BIGINT) AS mountNamespace",
    "CASE event_type WHEN 'click' THEN 'bash' WHEN 'view' THEN 'ps' WHEN 'signup' THEN 'sshd'"
    " WHEN 'purchase' THEN 'sudo' ELSE 'tsm' END AS processName",
    "concat('host-', CAST(user_id % 4 AS {text})) AS hostName",
    "CAST(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'signup' THEN 42"
    " WHEN 'purchase' THEN 257 ELSE 1010 END AS BIGINT) AS eventId",
    "event_type AS eventName",
    "CAST(k % 6 AS BIGINT) AS argsNum",
    "CAST(k - 50 AS BIGINT) AS returnValue",
    "CASE WHEN k % 6 = 0 THEN '[]' ELSE replace(concat('[{{~name~: ~fd~, ~type~: ~int~, ~value~: ',"
    " CAST(k AS {text}), '}}, {{~name~: ~pathname~, ~type~: ~const char*~, ~value~: ~',"
    " CASE WHEN k % 10 = 3 THEN '/tmp/a, b' ELSE '/usr/lib/c' END, '~}}]'), '~', chr(39)) END AS args",
    "value AS amount",
    "CAST(CASE WHEN event_type = 'error' OR value > 150 THEN 1 ELSE 0 END AS INT) AS sus",
    "CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS evil",
)


def _log_columns(seconds: str, text: str) -> list[str]:
    return [c.format(seconds=seconds, text=text) for c in _LOG_COLUMNS]


LOGS_SQL = (
    "SELECT "
    + ", ".join(_log_columns("(epoch_us(ts) - 1704067200000000) / 1e6", "VARCHAR"))
    + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e"
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.selectExpr(*_log_columns(f"CAST({micros} AS DOUBLE) / 1e6D", "STRING"))


def on_logs(body: str, **ctes: str) -> str:
    parts = [f"logs AS ({LOGS_SQL})", *[f"{k} AS ({v})" for k, v in ctes.items()]]
    return "WITH " + ", ".join(parts) + " " + body


BASE_COLS = ("isSystemProcess", "isSystemParentProcess", "isSystemUser", "isDefaultMountNamespace", "eventId", "argsNum", "returnValueCat")
RAW_BASE_SQL = """SELECT id, CAST(processId IN (0,1,2) AS DOUBLE) AS isSystemProcess,
  CAST(parentProcessId IN (0,1,2) AS DOUBLE) AS isSystemParentProcess, CAST(userId < 1000 AS DOUBLE) AS isSystemUser,
  CAST(mountNamespace = 4026531840 AS DOUBLE) AS isDefaultMountNamespace, CAST(eventId AS DOUBLE) AS eventId,
  CAST(argsNum AS DOUBLE) AS argsNum, CAST(sign(returnValue) AS DOUBLE) AS returnValueCat, sus, evil FROM logs"""


def standardized_sql(cols, source: str) -> str:
    """Columns of ``source`` as (x - mean) / population deviation."""
    return ", ".join(
        f"({c} - (SELECT avg({c}) FROM {source})) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM {source}) AS {c}"
        for c in cols
    )


BASE_SQL = f"SELECT id, {standardized_sql(BASE_COLS, 'raw_base')}, sus, evil FROM raw_base"
# A deterministic score: distance of the amount from its mean in deviations.
SCORED_SQL = """SELECT id, userId, evil, sus, amount, round(abs(amount - (SELECT avg(amount) FROM logs)) /
  (SELECT stddev_pop(amount) FROM logs), 6) AS score FROM logs"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with a deterministic score: distance of the amount from its mean in deviations."""
    df = logs(spark, sf_dir)
    m, s = df.agg(F.avg("amount"), F.stddev_pop("amount")).first()
    return df.select("id", "userId", "evil", "sus", "amount", F.round(F.abs(F.col("amount") - m) / s, 6).alias("score"))
