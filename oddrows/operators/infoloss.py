"""How much of a table's distribution a reduced sample keeps: histograms, divergences, class ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrows.operators.order import unpivot

BINS = 49
EPS = 1e-10


def cell(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width cell, last one closed; null outside the range."""
    spot = F.floor((value - lo) / (hi - lo) * bins)
    inside = (value >= lo) & (value <= hi)
    return F.when(inside & (hi > lo), F.least(F.lit(bins - 1), spot)).when(inside, F.lit(0)).cast("int")


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int = BINS) -> DataFrame:
    """Counts per equal-width bin, empty bins included: ``(bin, n)``."""
    counts = df.select(cell(F.col(col).cast("double"), F.lit(lo), F.lit(hi), bins).alias("bin")).filter("bin is not null")
    counts = counts.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def paired_histograms(a: DataFrame, b: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """Counts of both tables over their joint range per feature: ``(feature, bin, n_a, n_b)`` with zero bins.

    Both tables go through one union, so all features take one pass for the ranges and one for the counts.
    """
    both = unpivot(a, cols).withColumn("side", F.lit(0)).unionByName(unpivot(b, cols).withColumn("side", F.lit(1)))
    ranges = both.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = both.join(F.broadcast(ranges), "feature")  # one range per feature
    counts = placed.groupBy("feature", cell(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b")
    )
    every = a.sparkSession.createDataFrame([(c, i) for c in cols for i in range(bins)], "feature string, bin int")
    return every.join(F.broadcast(counts), ["feature", "bin"], "left").fillna(0, ["n_a", "n_b"])


def divergences(a: DataFrame, b: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    """KL and Jensen-Shannon divergence (natural log, no square root) per feature.

    Densities get a small constant before they are normalized again. A column with one value has one bin
    and no divergence.
    """
    both = unpivot(a, cols).unionByName(unpivot(b, cols))
    spans = both.groupBy("feature").agg((F.max("value") - F.min("value")).alias("span"))
    h = paired_histograms(a, b, cols, bins).join(F.broadcast(spans), "feature")
    w = Window.partitionBy("feature")  # one row per bin
    # a zero-width range counts as width 1, as numpy widens it
    width = F.when(F.col("span") > 0, F.col("span")).otherwise(1.0) / bins
    dens = h.withColumns(
        {s: F.col(f"n_{s}") / F.sum(f"n_{s}").over(w) / width + EPS for s in ("a", "b")}
    ).select("feature", "bin", "a", "b")
    p = dens.withColumns({s: F.col(s) / F.sum(s).over(w) for s in ("a", "b")})
    m = (F.col("a") + F.col("b")) / 2
    js = (F.col("a") * F.ln(F.col("a") / m) + F.col("b") * F.ln(F.col("b") / m)) / 2
    return p.groupBy("feature").agg(F.sum(F.col("a") * F.ln(F.col("a") / F.col("b"))).alias("kl"), F.sum(js).alias("js"))


def kl_divergence(a: DataFrame, b: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    return divergences(a, b, cols, bins).select("feature", "kl")


def js_divergence(a: DataFrame, b: DataFrame, cols: Sequence[str], bins: int = BINS) -> DataFrame:
    return divergences(a, b, cols, bins).select("feature", "js")


def class_ratio_diff(a: DataFrame, b: DataFrame, y: str) -> DataFrame:
    both = a.select(F.lit(0).alias("side"), F.col(y).alias("y")).unionByName(b.select(F.lit(1).alias("side"), F.col(y).alias("y")))
    r = both.agg(F.avg(F.when(F.col("side") == 0, F.col("y"))).alias("ratio_a"), F.avg(F.when(F.col("side") == 1, F.col("y"))).alias("ratio_b"))
    return r.withColumn("class_ratio_diff", F.abs(F.col("ratio_a") - F.col("ratio_b")))
