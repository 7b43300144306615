"""Session helpers: where intermediate results go, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that one task (or the driver) may hold at once; everything larger is kept distributed.
TASK_ROWS_KEY = "spark.oddrows.taskRows"
TASK_ROWS = 1_000_000
BROADCAST_ROWS_KEY = "spark.oddrows.broadcastRows"
BROADCAST_ROWS = 50_000


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, from ``spark.checkpoint.dir``.

    A machine-local folder is only made up when the session itself is local.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="oddrows-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize to the shared folder, so a lost executor costs no recomputation chain."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """True when the frame has no more than ``rows`` rows (stops counting right after)."""
    return df.limit(rows + 1).count() <= rows


def small_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Broadcast ``small`` only when its checked size allows; otherwise a shuffle join (AQE splits skew).

    The hint is needed: Spark assumes that a frame is as small as the compressed files it came from.
    """
    limit = setting(big.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS)
    return big.join(F.broadcast(small) if at_most(small, limit) else small.hint("merge"), on, how)
