"""Joins and set operations between result tables, samples and cluster verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.operators.neighbors import blockwise, knn_join, point
from oddrows.operators.order import key_numbers
from oddrows.session import at_most, small_join

MAX_LISTED = 2_000  # centres that may travel as one array

MEASURES = ("importance_dt", "importance_rf", "permutation_dt", "permutation_rf")


def compare_importances(dt: DataFrame, rf: DataFrame, perm_dt: DataFrame, perm_rf: DataFrame) -> DataFrame:
    """One row per feature with the four importance measures; each input is ``(feature, importance)``."""
    named = [d.select("feature", F.col("importance").alias(m)) for d, m in zip((dt, rf, perm_dt, perm_rf), MEASURES)]
    out = named[0].join(named[1], "feature", "inner")
    out = out.join(named[2], "feature", "left").join(named[3], "feature", "left")
    return out.orderBy(F.desc("importance_rf"), "feature")


def importance_agreement(table: DataFrame, measures: Sequence[str] = MEASURES, top: int = 3) -> DataFrame:
    """Correlation of every pair of measures and how many features their top lists share."""
    long = table.unpivot(["feature"], list(measures), "measure", "v").filter("v is not null")
    w = Window.partitionBy("measure").orderBy(F.desc("v"), "feature")  # one row per feature
    best = long.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    lists = best.groupBy("measure").agg(F.collect_set("feature").alias("top"))  # at most ``top`` names
    a = lists.select(F.col("measure").alias("a"), F.col("top").alias("top_a"))
    b = lists.select(F.col("measure").alias("b"), F.col("top").alias("top_b"))
    pairs = list(combinations(measures, 2))
    one = table.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{x}|{y}").alias("r")) for x, y in pairs]
    corr = one.select(F.inline(F.array(*cells)))
    out = corr.join(F.broadcast(a), "a").join(F.broadcast(b), "b")
    return out.select("a", "b", "r", F.size(F.array_intersect("top_a", "top_b")).cast("long").alias("shared_top"))


def broadcast_verdict(df: DataFrame, verdicts: DataFrame, cluster: str = "cluster", verdict: str = "verdict") -> DataFrame:
    """Give every row the verdict of its cluster; unknown clusters count as 0."""
    named = verdicts.select(F.col("cluster").alias(cluster), F.col("verdict").alias("_v"))
    return small_join(df, named, cluster).withColumn(verdict, F.coalesce("_v", F.lit(0))).drop("_v")


def center_distances(centers: DataFrame, cluster: str, xs: Sequence[str]) -> DataFrame:
    """Euclidean distance of every pair of centres ``(a, b, distance)``; the pair list is the result.

    A checked short list of centres travels as one array per row; more centres meet block by block.
    """
    if not at_most(centers, MAX_LISTED):
        numbers = key_numbers(centers, cluster)
        points = centers.join(numbers, cluster).select(F.col("_key").alias("pid"), F.lit(1).alias("w"), point(xs).alias("x"))

        def pairs_of(q, r, d2):
            a, b = np.repeat(q["qid"].to_numpy(), len(r)), np.tile(r["pid"].to_numpy(), len(q))
            return pd.DataFrame({"_a": a, "_b": b, "distance": np.sqrt(d2).ravel()})

        pairs = blockwise(points.withColumnRenamed("pid", "qid"), points, pairs_of, "_a long, _b long, distance double")
        name = lambda out: numbers.select(F.col("_key").alias(f"_{out}"), F.col(cluster).alias(out))
        return pairs.join(name("a"), "_a").join(name("b"), "_b").select("a", "b", "distance")
    entry = F.struct(F.col(cluster).alias("b"), F.array(*[F.col(x).cast("double") for x in xs]).alias("y"))
    everyone = Window.partitionBy(F.lit(1))
    listed = centers.select(
        F.col(cluster).alias("a"), F.array(*[F.col(x).cast("double") for x in xs]).alias("x"), F.collect_list(entry).over(everyone).alias("others")
    )
    pairs = listed.select("a", "x", F.inline("others"))
    sq = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return pairs.select("a", "b", F.sqrt(sq).alias("distance"))


def nearest_centers(centers: DataFrame, cluster: str, xs: Sequence[str], k: int = 5) -> DataFrame:
    """k closest other centres per centre: ``(a, b, distance, rank)``. Many centres go through the
    nearest-neighbour join, so the pair list is never formed."""
    if not at_most(centers, MAX_LISTED):
        near = knn_join(centers, xs, cluster, k)
        return near.select(F.col(cluster).alias("a"), F.col("neighbor").alias("b"), "distance", "rank")
    w = Window.partitionBy("a").orderBy("distance", "b")
    near = center_distances(centers, cluster, xs).filter("a <> b")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def min_center_separation(centers: DataFrame, cluster: str, xs: Sequence[str]) -> DataFrame:
    """Mean over centres of the distance to the nearest other centre."""
    return nearest_centers(centers, cluster, xs, 1).agg(F.avg("distance").alias("separation"))


def exclude_rows(df: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    return df.join(taken.select(id_col), id_col, "left_anti")


def semi_rows(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")


def semi_share(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """How many of the rows are in a sample, and their percentage (both counts in one pass over the union)."""
    found = semi_rows(df, ids, id_col).agg(F.count("*").alias("found"))
    whole = df.agg(F.count("*").alias("n"))
    both = found.withColumn("n", F.lit(None).cast("long")).unionByName(whole.withColumn("found", F.lit(None).cast("long")))
    sums = both.agg(F.max("found").alias("found"), F.max("n").alias("n"))
    return sums.withColumn("percent", F.when(F.col("n") > 0, F.col("found") * 100.0 / F.col("n")).otherwise(0.0))


def union_classes(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """All class values of two frames with counts and percentages side by side."""

    def side(df, tag):
        counts = df.groupBy(F.col(col).alias("class")).agg(F.count("*").alias(f"n_{tag}"))
        w = Window.partitionBy(F.lit(1))  # one row per class
        return counts.withColumn(f"percent_{tag}", F.col(f"n_{tag}") * 100.0 / F.sum(f"n_{tag}").over(w))

    out = side(a, "a").join(side(b, "b"), "class", "full")
    return out.select(
        "class", *[F.coalesce(c, F.lit(0 if c.startswith("n_") else 0.0)).alias(c) for c in ("n_a", "percent_a", "n_b", "percent_b")]
    )


def method_comparison(metrics: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Metric x method table from ``(method, metric, value)`` rows."""
    return metrics.groupBy("metric").pivot("method", list(methods)).agg(F.first("value"))


def best_method(metrics: DataFrame, wanted: Sequence[str], signed: bool = False) -> DataFrame:
    """Method with the lowest total over the named metrics (absolute values unless ``signed``)."""
    v = F.col("value") if signed else F.abs("value")
    totals = metrics.filter(F.col("metric").isin(list(wanted))).groupBy("method").agg(F.sum(v).alias("total"))
    return totals.agg(F.min_by("method", F.struct("total", "method")).alias("method"), F.min("total").alias("total"))
