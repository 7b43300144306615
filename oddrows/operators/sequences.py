"""Per-entity event sequences. A hot entity is split by time range, so no task holds all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.operators.order import range_bounds, with_range


def consecutive_events(df: DataFrame, user: str, time: str, flag: str, id_col: str) -> DataFrame:
    """Per user with more than one row: adjacent flagged pairs in time order and their share of n - 1.

    Pairs inside a time range come from a window per (user, range); pairs across ranges from the first and
    last flag of each range, a frame of at most users x ranges rows.
    """
    rows = df.select(user, F.col(time).cast("double").alias("_t"), F.col(flag).cast("int").alias("_f"), id_col)
    ranged = with_range(rows, "_t", range_bounds(rows, "_t"), "_range")
    inside = Window.partitionBy(user, "_range").orderBy("_t", id_col)
    order = F.struct("_t", id_col)
    pair = ((F.col("_f") == 1) & (F.lag("_f").over(inside) == 1)).cast("long")
    parts = (
        ranged.withColumn("_pair", F.coalesce(pair, F.lit(0)))
        .groupBy(user, "_range")
        .agg(
            F.count("*").alias("_n"),
            F.sum("_pair").alias("_pairs"),
            F.min_by("_f", order).alias("_first"),
            F.max_by("_f", order).alias("_last"),
        )
    )
    across = Window.partitionBy(user).orderBy("_range")  # at most one row per time range
    joint = ((F.col("_first") == 1) & (F.lag("_last").over(across) == 1)).cast("long")
    per_user = (
        parts.withColumn("_joint", F.coalesce(joint, F.lit(0)))
        .groupBy(user)
        .agg(F.sum("_n").alias("n"), F.sum(F.col("_pairs") + F.col("_joint")).alias("consecutive"))
        .filter("n > 1")
    )
    return per_user.withColumn("ratio", F.col("consecutive") / (F.col("n") - 1))


def suspicious_sequences(sequences: DataFrame, user: str, cut: float = 0.5, head: int | None = None) -> DataFrame:
    """Users whose ratio is above the cut, highest first; ``head`` turns it into a top-k report."""
    out = sequences.filter(F.col("ratio") > cut).orderBy(F.desc("ratio"), user)
    return out.limit(head) if head else out
