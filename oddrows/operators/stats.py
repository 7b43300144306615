"""Statistical tests from group moments and contingency counts.

Moments come from one aggregate; tail probabilities are Arrow-batched on the tiny result rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.operators.features import feature_group
from oddrows.operators.order import unpivot

# --- tail probabilities --------------------------------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def _each(fn, *columns):
    return pd.Series([fn(*v) if not any(x is None or x != x for x in v) else None for v in zip(*columns)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    return _each(lambda a, n: beta_inc(n / 2, 0.5, n / (n + a * a)) if n > 0 else None, t, dof)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda v, a, b: beta_inc(b / 2, a / 2, b / (b + a * v)), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(lambda v, k: gamma_upper(k / 2, v / 2) if k > 0 else 1.0, x, dof)


# --- tests ---------------------------------------------------------------------------------------


def _welch(moments: DataFrame) -> DataFrame:
    """t, degrees of freedom, effect from ``n_in, m_in, v_in, n_out, m_out, v_out`` columns."""
    a, b = F.col("v_in") / F.col("n_in"), F.col("v_out") / F.col("n_out")
    diff = F.col("m_in") - F.col("m_out")
    return moments.withColumns(
        {
            "t": F.when(a + b > 0, diff / F.sqrt(a + b)),
            "dof": F.when(a + b > 0, (a + b) * (a + b) / (a * a / (F.col("n_in") - 1) + b * b / (F.col("n_out") - 1))),
            "effect_size": F.abs(diff / (F.sqrt("v_in") + 1e-6)),
        }
    )


def welch_t(df: DataFrame, in_cluster: str, cols: Sequence[str]) -> DataFrame:
    """Unequal-variance t-test of every column inside vs outside a cluster (0/1 column)."""
    long = unpivot(df, cols, [in_cluster])
    x_in, x_out = (F.when(F.col(in_cluster) == k, F.col("value")) for k in (1, 0))
    m = long.groupBy("feature").agg(
        F.count(x_in).alias("n_in"), F.avg(x_in).alias("m_in"), F.var_samp(x_in).alias("v_in"),
        F.count(x_out).alias("n_out"), F.avg(x_out).alias("m_out"), F.var_samp(x_out).alias("v_out"),
    )
    return _welch(m).withColumn("p", t_pvalue("t", "dof")).select("feature", "t", "dof", "p", "effect_size")


def _chi2(cells: DataFrame, keys: Sequence[str], row: str, col: str) -> DataFrame:
    """Chi-square per key from complete or sparse ``(keys, row, col, n)`` counts, Yates on 2x2.

    Absent cells contribute their expected count: sum over all cells of (O-E)^2/E equals
    sum over present cells of O^2/E minus n (the correction needs the full 2x2, which is filled in).
    """
    keys = list(keys)
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    marked = cells.withColumns(
        {
            "_r": F.sum("n").over(Window.partitionBy(*keys, row)),
            "_c": F.sum("n").over(Window.partitionBy(*keys, col)),
            "_t": F.sum("n").over(every),
        }
    )
    e = F.col("_r") * F.col("_c") / F.col("_t")
    plain = F.col("n") * F.col("n") / e
    one = marked.groupBy(*keys).agg(
        F.count_distinct(row).alias("_k"), F.count_distinct(col).alias("_m"), F.max("_t").alias("_n"), F.sum(plain).alias("_s"),
        F.min(e).alias("_e"), F.max(F.abs(F.col("n") - e)).alias("_gap"), F.sum(1 / e).alias("_inv"), F.count("*").alias("_cells"),
        F.min("_r").alias("_r1"), F.min("_c").alias("_c1"),
    )
    dof = (F.col("_k") - 1) * (F.col("_m") - 1)
    # in a 2x2 every cell misses its expectation by the same amount
    n = F.col("_n")
    inv = n / F.col("_r1") / F.col("_c1") + n / (n - F.col("_r1")) / F.col("_c1") + n / F.col("_r1") / (n - F.col("_c1")) + n / (n - F.col("_r1")) / (n - F.col("_c1"))
    shrunk = F.greatest(F.col("_gap") - F.least(F.lit(0.5), F.col("_gap")), F.lit(0.0))
    chi2 = F.when((F.col("_k") == 2) & (F.col("_m") == 2), shrunk * shrunk * inv).when(dof == 0, 0.0).otherwise(F.col("_s") - n)
    return one.select(*keys, chi2.alias("chi2"), dof.cast("double").alias("dof"))


def chi2_independence(df: DataFrame, in_cluster: str, col: str) -> DataFrame:
    cells = df.groupBy(in_cluster, col).agg(F.count("*").alias("n"))
    out = _chi2(cells, [], in_cluster, col)
    return out.withColumn("p", chi2_pvalue("chi2", "dof")).withColumn("effect_size", F.col("chi2"))


def cluster_feature_tests(
    df: DataFrame, cluster: str, cols: Sequence[str], clusters: Sequence[int], few: int = 10
) -> DataFrame:
    """Every named cluster x every feature: t-test for features with more than ``few`` values, else chi-square.

    One grouping by (feature, cluster, value) of the few-valued features and one of moments serve all clusters;
    "outside" is the total less the cluster itself.
    """
    long = unpivot(df, cols, [cluster]).filter("value is not null")
    # distinct values are counted up to the point where the kind is decided
    kinds = {r["feature"]: r["k"] for r in long.groupBy("feature").agg(F.approx_count_distinct("value", 0.01).alias("k")).collect()}
    maybe = [c for c, k in kinds.items() if k <= 4 * few]
    exact = {
        r["feature"]: r["k"]
        for r in long.filter(F.col("feature").isin(maybe)).groupBy("feature").agg(F.count_distinct("value").alias("k")).collect()
    }
    cats = [c for c in cols if exact.get(c, few + 1) <= few]
    nums = [c for c in cols if c not in cats]
    wanted = F.explode(F.array(*[F.lit(int(c)) for c in clusters]))
    parts = []
    if nums:
        sums = long.filter(F.col("feature").isin(nums)).groupBy("feature", F.col(cluster).alias("c"))
        m = sums.agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
        listed = m.groupBy("feature").agg(F.collect_list(F.struct("c", "n", "m", "v")).alias("all"))  # one entry per cluster

        def pooled(sel, tag):
            part = F.filter("all", sel)
            n = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x["n"])
            mean = F.aggregate(part, F.lit(0.0), lambda s, x: s + x["n"] * x["m"]) / n
            return {f"n_{tag}": n, f"m_{tag}": mean, f"_p_{tag}": part}

        spread = listed.withColumn("cluster", wanted)
        spread = spread.withColumns({**pooled(lambda x: x["c"] == F.col("cluster"), "in"), **pooled(lambda x: x["c"] != F.col("cluster"), "out")})
        for tag in ("in", "out"):
            mean = F.col(f"m_{tag}")
            ss = F.aggregate(F.col(f"_p_{tag}"), F.lit(0.0), lambda s, x: s + x["n"] * (x["v"] + (x["m"] - mean) * (x["m"] - mean)))
            spread = spread.withColumn(f"v_{tag}", F.when(F.col(f"n_{tag}") > 1, ss / (F.col(f"n_{tag}") - 1)))
        t = _welch(spread).withColumn("p", t_pvalue("t", "dof"))
        parts.append(t.select("cluster", "feature", F.lit("numeric").alias("type"), "p", "effect_size"))
    if cats:
        counts = long.filter(F.col("feature").isin(cats)).groupBy("feature", F.col(cluster).alias("c"), "value").agg(F.count("*").alias("n"))
        cells = counts.withColumn("cluster", wanted).groupBy("cluster", "feature", (F.col("c") == F.col("cluster")).alias("inside"), "value").agg(F.sum("n").alias("n"))
        x = _chi2(cells, ["cluster", "feature"], "inside", "value").withColumn("p", chi2_pvalue("chi2", "dof"))
        parts.append(x.select("cluster", "feature", F.lit("categorical").alias("type"), "p", F.col("chi2").alias("effect_size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("grp", feature_group(F.col("feature"))).orderBy("cluster", "p", F.desc("effect_size"), "feature")


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    one = g.agg(n.alias("n"), k.alias("k"), between.alias("ssb"), within.alias("ssw"))
    out = one.select(
        ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"),
        (F.col("k") - 1).cast("double").alias("d1"),
        (F.col("n") - F.col("k")).cast("double").alias("d2"),
    )
    return out.select("f", f_pvalue("f", "d1", "d2").alias("p"))


def paired_t(df: DataFrame, method: str, key: str, value: str) -> DataFrame:
    """Paired t-test for every pair of methods over shared keys; one self join on the key."""
    a = df.select(F.col(key).alias("k"), F.col(method).alias("a"), F.col(value).alias("x"))
    b = df.select(F.col(key).alias("k"), F.col(method).alias("b"), F.col(value).alias("y"))
    d = a.join(b, "k").filter("a < b").select("a", "b", (F.col("x") - F.col("y")).alias("d"))
    m = d.groupBy("a", "b").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = m.select(
        "a", "b", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("dof")
    )
    return t.withColumn("p", t_pvalue("t", "dof"))


def cluster_feature_shift(df: DataFrame, in_cluster: str, cols: Sequence[str]) -> DataFrame:
    """Mean difference, ratio of population deviations, importance = |diff| * (1 + |1 - ratio|)."""
    long = unpivot(df, cols, [in_cluster])
    x_in, x_out = (F.when(F.col(in_cluster) == k, F.col("value")) for k in (1, 0))
    m = long.groupBy("feature").agg(
        F.avg(x_in).alias("mean_in"), F.avg(x_out).alias("mean_out"), F.stddev_pop(x_in).alias("s_in"), F.stddev_pop(x_out).alias("s_out")
    )
    diff = F.col("mean_in") - F.col("mean_out")
    rel = F.col("s_in") / (F.col("s_out") + 1e-10)
    out = m.select("feature", "mean_in", "mean_out", diff.alias("diff"), rel.alias("std_ratio"))
    return out.withColumn("importance", F.abs("diff") * (1 + F.abs(1 - F.col("std_ratio")))).orderBy(F.desc("importance"), "feature")
