"""Profiling aggregates: overview, missing values, moments, categories, correlations, entities, periods."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.columns import class3, clean_number, ratio
from oddrows.operators.features import (
    cut_edges,
    cut_equal_width,
    feature_group,
    hour_of_day,
)
from oddrows.operators.order import column_stats, exact_quantiles, quantile_table, quantile_values, unpivot

# --- tables and columns --------------------------------------------------------------------------


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per type, as ``(fact, value)`` rows."""
    kinds: dict[str, int] = {}
    for f in df.schema:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    facts = [("columns", len(df.columns)), *[(f"type:{k}", v) for k, v in sorted(kinds.items())]]
    fixed = df.sparkSession.createDataFrame(facts, "fact string, value long")
    return df.agg(F.lit("rows").alias("fact"), F.count("*").alias("value")).unionByName(fixed)


def first_rows(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """The first rows in key order, cell by cell: row (from 1), column, value as text."""
    cell = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    # the n rows are one array, which numbers them
    top = df.orderBy(id_col).limit(n).agg(F.sort_array(F.collect_list(F.struct(F.col(f"`{id_col}`").alias("key"), cell.alias("row")))).alias("rows"))
    each = top.select(F.posexplode("rows").alias("_at", "_e"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_e.row.`{c}`").alias("value")) for c in df.columns])
    return each.select((F.col("_at") + 1).cast("int").alias("row"), F.inline(cells))


def column_bytes(df: DataFrame) -> DataFrame:
    """Stored bytes per column: text length in bytes, or fixed width times non-null values."""
    width = {"tinyint": 1, "smallint": 2, "int": 4, "float": 4, "boolean": 1, "date": 4}
    sizes = []
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(F.col(f.name)).cast("long").alias(f.name))
        else:
            w = width.get(f.dataType.simpleString(), 8)
            sizes.append(F.when(F.col(f.name).isNotNull(), F.lit(w).cast("long")).alias(f.name))
    return column_stats(df.select(*sizes), df.columns, {"bytes": lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))})


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat another row; grouping first means hot copies collapse before the shuffle."""
    cols = list(cols or df.columns)
    copies = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    dup = F.sum(F.col("_n") - 1).cast("long")
    return copies.agg(
        F.sum("_n").cast("long").alias("n_rows"), dup.alias("duplicates"), (dup * 100.0 / F.sum("_n")).alias("percent")
    )


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    parts = []
    for c in cols:
        kind = df.schema[c].dataType
        gap = F.col(c).isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c).isNull()
        parts.append(gap.cast("long").alias(c))
    out = column_stats(df.select(*parts), cols, {"missing": F.sum, "percent": lambda c: F.avg(c) * 100})
    return out.filter("missing > 0").orderBy(F.desc("missing"), "feature")


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes, quartiles, range and coefficient of variation per column."""
    cleaned = df.select(*[clean_number(F.col(c)).alias(c) for c in cols])
    moments = column_stats(cleaned, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    q = quantile_table(cleaned, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = moments.join(F.broadcast(q), "feature", "left")
    return out.withColumns({"range": F.col("max") - F.col("min"), "cv": F.col("std") / F.col("mean")})


def skew_profile(df: DataFrame, cols: Sequence[str], cut: float = 1.0) -> DataFrame:
    cleaned = df.select(*[clean_number(F.col(c)).alias(c) for c in cols])
    out = column_stats(cleaned, cols, {"skewness": F.skewness})
    return out.filter(F.abs("skewness") > cut).orderBy(F.desc(F.abs("skewness")), "feature")


def value_counts(df: DataFrame, col: str, all_up_to: int = 20, top: int = 10) -> DataFrame:
    """Count per value, most frequent first; the whole list when short, else the top values (a report)."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "value").limit(all_up_to + 1)
    size = Window.partitionBy(F.lit(1))  # at most all_up_to + 1 rows
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "value")
    marked = ranked.withColumns({"_k": F.count("*").over(size), "_r": F.row_number().over(place)})
    return marked.filter((F.col("_k") <= all_up_to) | (F.col("_r") <= top)).select("value", "n")


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values, top value (smallest on ties), its count and share; one pass over all columns."""
    counts = unpivot(df, cols, as_type="string").groupBy("feature", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    best = F.min_by(F.struct("value", "n"), F.when(known, F.struct((-F.col("n")).alias("c"), "value")))
    out = counts.groupBy("feature").agg(F.count("value").alias("unique_values"), best.alias("b"), F.sum("n").alias("rows"))
    return out.select(
        "feature",
        "unique_values",
        F.col("b.value").alias("top_value"),
        F.col("b.n").alias("top_count"),
        (F.col("b.n") * 100.0 / F.col("rows")).alias("top_percent"),
    )


def feature_ranges(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Minimum, maximum and number of distinct values per feature (counted after collapsing repeats)."""
    long = unpivot(df, cols)
    if approximate:
        return long.groupBy("feature").agg(
            F.min("value").alias("min"), F.max("value").alias("max"), F.approx_count_distinct("value").alias("distinct_values")
        )
    values = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    return values.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("distinct_values")
    )


# --- targets and correlations --------------------------------------------------------------------


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, with the ratio of the smallest to the largest class."""
    counts = df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per class
    return counts.select(
        "target",
        "n",
        (F.col("n") * 100.0 / F.sum("n").over(w)).alias("percent"),
        (F.min("n").over(w) / F.max("n").over(w)).alias("imbalance"),
    )


def class_distribution(df: DataFrame) -> DataFrame:
    one = df.agg(
        F.count("*").alias("n"),
        F.count_if((F.col("evil") == 0) & (F.col("sus") == 0)).alias("benign"),
        F.count_if((F.col("evil") == 0) & (F.col("sus") == 1)).alias("suspicious"),
        F.count_if(F.col("evil") == 1).alias("malicious"),
    )
    long = one.unpivot(["n"], ["benign", "suspicious", "malicious"], "class", "rows")
    return long.select("class", "rows", (F.col("rows") * 100.0 / F.col("n")).alias("percent"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair in long form: a, b, i, j, r.

    A pair is judged by the rows where both columns have a value (null and NaN are none); without two such rows, or where a column
    is constant on them, r is null. Tasks sum products of column blocks, so the plan is as small for 300 columns as for three.
    """
    k = len(cols)
    table = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = table.agg(*[F.avg(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}"))) for i in range(k)]).first()
    shift = np.array([m or 0.0 for m in means])
    upper = np.triu_indices(k)
    names = ["n", "si", "sj", "qi", "qj", "c"]

    def products(batches):
        sums = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            known = known.astype(float)
            s, q = x.T @ known, (x * x).T @ known
            sums += [known.T @ known, s, s.T, q, q.T, x.T @ x]
        flat = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *[pa.array(m[upper]) for m in sums]]
        yield pa.RecordBatch.from_arrays(flat, names=["i", "j", *names])

    parts = table.mapInArrow(products, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    n, si, sj, qi, qj, c = (F.sum(x) for x in names)
    spread = F.when(n * qi - si * si > 1e-12 * n * qi, n * qi - si * si), F.when(n * qj - sj * sj > 1e-12 * n * qj, n * qj - sj * sj)
    both = parts.groupBy("i", "j").agg(n.alias("n"), (n * c - si * sj).alias("top"), *[v.alias(f"v{k}") for k, v in enumerate(spread)])
    r = F.when(F.col("n") > 1, F.col("top") / F.sqrt("v0") / F.sqrt("v1"))
    cells = both.select("i", "j", F.when(F.col("i") == F.col("j"), F.when(r.isNotNull(), 1.0)).otherwise(r).alias("r"))
    every = cells.unionByName(cells.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    name = F.lit(list(cols))
    return every.select(F.element_at(name, F.col("i") + 1).alias("a"), F.element_at(name, F.col("j") + 1).alias("b"), "i", "j", "r")


def high_correlations(df: DataFrame, cols: Sequence[str], cut: float = 0.8) -> DataFrame:
    upper = correlation_matrix(df, cols).filter("i < j").filter(F.abs("r") > cut)
    return upper.select("a", "b", "r").orderBy(F.desc(F.abs("r")), "a", "b")


def correlation_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """r of every column with a target or score, and its absolute value."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    out = one.unpivot([], list(cols), "feature", "r")
    return out.withColumn("abs_r", F.abs("r")).orderBy(F.desc("abs_r"), "feature")


# --- entities ------------------------------------------------------------------------------------


def unique_entities(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().agg(F.count(col).alias("n_entities"))


def entity_stats(df: DataFrame, user: str, target: str) -> DataFrame:
    return df.groupBy(user).agg(
        F.count("*").alias("actions"), F.sum(target).cast("long").alias("evil_actions"), F.avg(target).alias("evil_ratio")
    )


def describe_entities(df: DataFrame, user: str, target: str) -> DataFrame:
    return describe_numeric(entity_stats(df, user, target), ["actions", "evil_actions", "evil_ratio"])


def suspicious_entities(df: DataFrame, user: str, target: str, cut: float = 0.5) -> DataFrame:
    return entity_stats(df, user, target).filter(F.col("evil_ratio") > cut).orderBy(F.desc("evil_ratio"), user)


# --- periods -------------------------------------------------------------------------------------


def period_activity(df: DataFrame, time: str, target: str, n: int = 24) -> DataFrame:
    """Rows and evil ratio per equal-width period; periods without rows appear with zeros."""
    binned = cut_equal_width(df, time, n, "period").filter("period is not null")
    stats = binned.groupBy("period").agg(F.count("*").alias("n_rows"), F.avg(target).alias("ratio"))
    every = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("period"))
    return every.join(F.broadcast(stats), "period", "left").select(
        "period", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("ratio", F.lit(0.0)).alias("evil_ratio")
    )


def hourly_ratio(df: DataFrame, time: str, target: str) -> DataFrame:
    """Mean target per hour of day, right-closed hour bins (0.0 h itself falls outside)."""
    hours = cut_edges(hour_of_day(df, time, "_hour"), "_hour", [float(h) for h in range(25)], "hour_bin")
    return hours.filter("hour_bin is not null").groupBy("hour_bin").agg(F.avg(target).alias("evil_ratio"), F.count("*").alias("n_rows"))


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


# --- scores, clusters, embeddings ----------------------------------------------------------------


def score_by_class(df: DataFrame, score: str) -> DataFrame:
    """Rows, extremes, mean and median of a score overall (class ``all``) and per class."""
    classed = df.select(class3().alias("class"), F.col(score).alias("score"))
    both = classed.unionByName(classed.withColumn("class", F.lit("all")))
    stats = both.groupBy("class").agg(
        F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean")
    )
    med = exact_quantiles(both, ["score"], [0.5], ["class"]).select("class", F.col("value").alias("median"))
    return stats.join(F.broadcast(med), "class", "left")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def mean_std_over_runs(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over repeats; NaN and null results are skipped."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


def cluster_composition(df: DataFrame, cluster: str, target: str, min_percent: float = 90.0, min_rows: int = 20) -> DataFrame:
    """Size and evil share per cluster (noise is -1), marking large, almost pure evil clusters."""
    out = df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count("*").alias("n"), F.sum(target).cast("long").alias("evil_n"), (F.avg(target) * 100).alias("evil_percent")
    )
    pure = (F.col("evil_percent") >= min_percent) & (F.col("n") >= min_rows) & (F.col("cluster") != -1)
    return out.withColumn("is_evil_cluster", pure.cast("int"))


def label_shares(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per label
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(w))


def centroid_spread(df: DataFrame, label: str, xs: Sequence[str]) -> DataFrame:
    aggs = [a for x in xs for a in (F.avg(x).alias(f"{x}_mean"), F.stddev_samp(x).alias(f"{x}_std"))]
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *aggs)


def axis_ranges(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Extremes and range per embedding axis, and the ratio of the first axis' range to each."""
    one = df.agg(*[a for x in xs for a in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))])
    first = F.col(f"hi_{xs[0]}") - F.col(f"lo_{xs[0]}")
    cells = []
    for x in xs:
        span = F.col(f"hi_{x}") - F.col(f"lo_{x}")
        aspect = F.when(span != 0, first / span)
        cells.append(
            F.struct(F.lit(x).alias("axis"), F.col(f"lo_{x}").alias("min"), F.col(f"hi_{x}").alias("max"), span.alias("range"), aspect.alias("aspect"))
        )
    return one.select(F.inline(F.array(*cells)))


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences per column, and their share."""
    marks = []
    for c, (q1, q3) in quantile_values(df, cols, [0.25, 0.75]).items():
        v = F.col(c).cast("double")
        out = F.lit(False) if q1 is None else (v < F.lit(q1 - k * (q3 - q1))) | (v > F.lit(q3 + k * (q3 - q1)))
        marks.append(F.coalesce(out, F.lit(False)).alias(c))
    return column_stats(df.select(*marks), cols, {"outliers": F.count_if, "percent": lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))})


def feature_group_effects(stats: DataFrame, top: int = 3, alpha: float = 0.05) -> DataFrame:
    """Significant test results by feature group (text before the first ``_``), strongest groups first."""
    strong = stats.filter(F.col("p") < alpha).withColumn("grp", feature_group(F.col("feature")))
    out = strong.groupBy("grp").agg(F.sum("effect_size").alias("total_effect"), F.count("feature").alias("n"))
    return out.withColumn("normalized", F.col("total_effect") / F.col("n")).orderBy(F.desc("normalized"), "grp").limit(top)


def eda_facts(df: DataFrame, user: str, target: str, cut: float = 0.5) -> DataFrame:
    """Headline facts as ``(fact, value)``: table shape, classes, users, suspicious users."""
    rows = table_overview(df).filter(F.col("fact").isin("rows", "columns")).select("fact", F.col("value").cast("double").alias("value"))
    classes = target_distribution(df, target).select(
        F.concat(F.lit("class "), F.col("target").cast("string")).alias("fact"), F.col("n").cast("double").alias("value")
    )
    users = unique_entities(df, user).select(F.lit("entities").alias("fact"), F.col("n_entities").cast("double").alias("value"))
    odd = entity_stats(df, user, target).agg(F.count_if(F.col("evil_ratio") > cut).cast("double").alias("value"))
    return rows.unionByName(classes).unionByName(users).unionByName(odd.select(F.lit("suspicious entities").alias("fact"), "value"))


def eda_summary(df: DataFrame, user: str, target: str, importance: DataFrame, cut: float = 0.5, top: int = 3) -> DataFrame:
    """The headline facts plus the strongest features ``(feature, importance)``."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(top)
    named = best.select(F.concat(F.lit("feature "), "feature").alias("fact"), F.col("importance").cast("double").alias("value"))
    return eda_facts(df, user, target, cut).unionByName(named)
