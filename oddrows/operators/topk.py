"""Top-k reports, exact top fractions and small rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.operators.order import column_stats, order_statistics


def top_anomalies(df: DataFrame, score: str, id_col: str, k: int = 20) -> DataFrame:
    """The k highest scores (a report); ties go to the smaller key."""
    return df.orderBy(F.desc(score), id_col).limit(k)


def flag_top_fraction(df: DataFrame, score: str, id_col: str, frac: float, out: str = "pred") -> DataFrame:
    """1 for the N = max(1, int(frac * n)) highest scores, ties by key.

    The N-th score and, among rows tied with it, the last admitted key are found as order statistics; the
    flag itself is then a projection over the table.
    """
    cut = top_cut(df, score, id_col, frac)
    if cut is None:
        return df.withColumn(out, F.lit(0))
    value, last_id = cut
    return df.withColumn(
        out, ((F.col(score) > F.lit(value)) | ((F.col(score) == F.lit(value)) & (F.col(id_col) <= F.lit(last_id)))).cast("int")
    )


def top_cut(df: DataFrame, score: str, id_col: str, frac: float):
    """(N-th highest score, largest admitted key among its ties)."""
    asked: dict = {}

    def ranks(sizes):
        n = sizes.get((0,), 0)
        if n:
            asked["n"], asked["take"] = n, max(1, int(frac * n))
            return {(0,): [n - asked["take"] + 1]}
        return {}

    row = order_statistics(df, score, ranks).first()
    if row is None:
        return None
    above = asked["n"] - row["below"] - row["equal"]
    want = asked["take"] - above
    ties = df.filter(F.col(score) == F.lit(row["value"]))
    last = order_statistics(ties, id_col, lambda sizes: {g: [want] for g in sizes}).first()
    return row["value"], last["value"]


def rank_features(importance: DataFrame, value: str = "importance", name: str = "feature") -> DataFrame:
    """Descending rank by absolute value; one row per feature, so a single window is small."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.abs(value)), name)
    return importance.withColumn("rank", F.row_number().over(w))


def top_features(importance: DataFrame, k: int, value: str = "importance", name: str = "feature") -> DataFrame:
    return importance.orderBy(F.desc(value), name).limit(k)


def top_variance_dims(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    spread = column_stats(df, cols, {"variance": F.var_samp})
    return spread.orderBy(F.desc("variance"), "feature").limit(k)


def closest_to_center(df: DataFrame, cluster: str, dist: str, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """The row nearest its centre per cluster (smallest key on ties), by a partial aggregate, no sort."""
    row = F.struct(dist, id_col, *keep)
    return df.groupBy(cluster).agg(F.min(row).alias("_r")).select(cluster, "_r.*")
