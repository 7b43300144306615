"""The numbers behind the figures: histograms, density curves, box summaries, scatter samples, grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.functions.columns import seeded_number
from oddrows.operators.infoloss import cell
from oddrows.operators.order import quantile_table, quantile_values
from oddrows.operators.sampling import sample_n


def hist_by_class(df: DataFrame, score: str, group: str, bins: int = 50, upper_pct: float | None = None) -> DataFrame:
    """Density histogram of a score per class over its range (or up to a percentile): ``(class, bin, left, n, density)``."""
    s = F.col(score).cast("double")
    lo, hi = df.agg(F.min(s), F.max(s)).first()
    if upper_pct is not None:
        hi = quantile_values(df.select(s.alias("s")), ["s"], [upper_pct / 100.0])["s"][0]
    placed = df.select(F.col(group).alias("class"), cell(s, F.lit(float(lo)), F.lit(float(hi)), bins).alias("bin"))
    counts = placed.filter("bin is not null").groupBy("class", "bin").agg(F.count("*").alias("n"))
    width = (float(hi) - float(lo)) / bins
    w = Window.partitionBy("class")  # one row per bin
    out = counts.withColumn("density", F.col("n") / F.sum("n").over(w) / F.lit(width or 1.0))
    return out.select("class", "bin", (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("left"), "n", "density")


def kde_curve(df: DataFrame, col: str, group: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """One-dimensional Gaussian density per class on an even grid: ``(class, x, density)``.

    Equal values are combined first, then every distinct value adds to the whole grid inside one row, so
    the grid never multiplies the rows. The bandwidth defaults to n^(-1/5) deviations per class.
    """
    rows = df.select(F.col(group).alias("class"), F.col(col).cast("double").alias("v")).filter("v is not null")
    stats = rows.groupBy("class").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("s"))
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    step = (hi - lo) / (points - 1)
    grid = [lo + i * step for i in range(points)]
    h = F.lit(bandwidth) if bandwidth else F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    values = rows.groupBy("class", "v").agg(F.count("*").alias("w")).join(stats.withColumn("h", h), "class")

    def kernel(x):
        u = (F.lit(x) - F.col("v")) / F.col("h")
        return F.col("w") * F.exp(-0.5 * u * u)

    sums = values.groupBy("class").agg(
        F.first("n").alias("n"), F.first("h").alias("h"), *[F.sum(kernel(x)).alias(f"g{i}") for i, x in enumerate(grid)]
    )
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"g{i}").alias("s")) for i, x in enumerate(grid)])
    return sums.select("class", "n", "h", F.inline(cells)).select(
        "class", "x", (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")
    )


def box_violin_summary(df: DataFrame, group: str, value: str, log1p: bool = False) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR), mean and rows per group."""
    v = F.log1p(F.col(value)) if log1p else F.col(value).cast("double")
    rows = df.select(F.col(group).alias("class"), v.alias("value"))
    q = quantile_table(rows, ["value"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["class"]).drop("feature")
    iqr = F.col("q3") - F.col("q1")
    joined = rows.join(q, "class")
    v = F.col("value")
    return joined.groupBy("class", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("low_whisker"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("high_whisker"),
        F.avg("value").alias("mean"),
        F.count("*").alias("n"),
    )


def scatter_sample(
    df: DataFrame, xs: Sequence[str], id_col: str, keep: Sequence[str] = (), n: int = 10_000, jitter: float | None = None, seed: int = 42
) -> DataFrame:
    """Seeded sample of points with their labels; optional Gaussian jitter, repeatable per row."""
    out = sample_n(df.select(id_col, *keep, *xs), id_col, n, seed)
    if jitter:
        for i, x in enumerate(xs):
            u1 = (seeded_number(seed + 2 * i + 1, id_col) + 1) / F.lit(2.0**52)
            u2 = seeded_number(seed + 2 * i + 2, id_col) / F.lit(2.0**52)
            out = out.withColumn(x, F.col(x) + F.lit(jitter) * F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2))
    return out


def grid_matrix(df: DataFrame, row: str, col: str, value: str, columns: Sequence) -> DataFrame:
    """Heat map: one row per ``row`` value, one column per ``col`` value (mean over repeats)."""
    return df.groupBy(row).pivot(col, list(columns)).agg(F.avg(value))


def best_slices(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Trend lines through the best cell: its whole row and its whole column, ``(slice, position, value)``."""
    cells = df.groupBy(row, col).agg(F.avg(value).alias("v")).filter("v is not null and not isnan(v)")
    w = Window.partitionBy(F.lit(1))  # grid cells
    top = F.max_by(F.struct(row, col), F.struct("v", (-F.col(row)).alias("r"), (-F.col(col)).alias("c"))).over(w)
    marked = cells.withColumn("_b", top)
    along_row = marked.filter(F.col(row) == F.col(f"_b.{row}")).select(F.lit("best row").alias("slice"), F.col(col).alias("position"), F.col("v").alias("value"))
    along_col = marked.filter(F.col(col) == F.col(f"_b.{col}")).select(F.lit("best column").alias("slice"), F.col(row).alias("position"), F.col("v").alias("value"))
    return along_row.unionByName(along_col)
