"""Joins, set operations and method comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import SCORED_SQL, logs, on_logs, query, rounded, scored
from oddrows.checks.profile import AXES, CENTER_SQL, label_centers, union_of
from oddrows.operators import joins as jn

MEASURES = ["amount", "returnValue", "argsNum", "eventId", "processId"]


def measure_frame(spark, sf_dir, target, cols):
    df = logs(spark, sf_dir)
    one = df.agg(*[F.round(F.abs(F.corr(F.col(c).cast("double"), F.col(target).cast("double"))), 6).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "importance")


def measure_sql(target, cols):
    return union_of(cols, "SELECT '{c}' AS feature, round(abs(corr({c}, " + target + ")), 6) AS importance FROM logs")


# four importance tables: the relation of every feature to a target; the last two lack a feature each
SIDES = [("evil", MEASURES), ("sus", MEASURES), ("timestamp", MEASURES[:4]), ("userId", MEASURES[1:])]
SIDE_CTES = {f"m{i}": measure_sql(w, c) for i, (w, c) in enumerate(SIDES)}
COMPARE = "SELECT feature, m0.importance AS importance_dt, m1.importance AS importance_rf, m2.importance AS permutation_dt, m3.importance AS permutation_rf FROM m0 JOIN m1 USING (feature) LEFT JOIN m2 USING (feature) LEFT JOIN m3 USING (feature)"


def compared(spark, sf_dir):
    return jn.compare_importances(*[measure_frame(spark, sf_dir, w, c) for w, c in SIDES])


@query("compare_importances", on_logs(COMPARE, **SIDE_CTES))
def compare_importances(spark, sf_dir):
    return compared(spark, sf_dir)


def _agreement_sql():
    names = jn.MEASURES
    tops = {f"t_{m}": f"SELECT feature FROM c WHERE {m} IS NOT NULL ORDER BY {m} DESC, feature LIMIT 3" for m in names}
    rows = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r, (SELECT count(*) FROM t_{a} JOIN t_{b} USING (feature)) AS shared_top FROM c"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return on_logs(" UNION ALL ".join(rows), **SIDE_CTES, c=COMPARE, **tops)


@query("importance_agreement", _agreement_sql())
def importance_agreement(spark, sf_dir):
    return rounded(jn.importance_agreement(compared(spark, sf_dir)))


@query("broadcast_verdict", on_logs("SELECT id, eventId AS cluster, coalesce(CAST(CASE WHEN eventId IN (3, 5) THEN 0 WHEN eventId = 1010 THEN 1 END AS INT), 0) AS verdict FROM logs"))
def broadcast_verdict(spark, sf_dir):
    df = logs(spark, sf_dir)
    seen = df.filter("eventId IN (3, 5, 1010)").groupBy(F.col("eventId").alias("cluster")).agg((F.avg("evil") > 0.2).cast("int").alias("verdict"))
    return jn.broadcast_verdict(df.select("id", F.col("eventId").alias("cluster")), seen).select("id", "cluster", "verdict")


@query("center_distances", CENTER_SQL + "SELECT a, b, round(distance, 6) AS distance FROM d")
def center_distances(spark, sf_dir):
    return rounded(jn.center_distances(label_centers(spark, sf_dir), "label", AXES))


@query("min_center_separation", CENTER_SQL + "SELECT round(avg(m), 6) AS separation FROM (SELECT min(distance) AS m FROM d WHERE a <> b GROUP BY a)")
def min_center_separation(spark, sf_dir):
    return rounded(jn.min_center_separation(label_centers(spark, sf_dir), "label", AXES))


@query("exclude_rows", on_logs("SELECT id, evil FROM logs WHERE id NOT IN (SELECT id FROM s WHERE score > 1)", s=SCORED_SQL))
def exclude_rows(spark, sf_dir):
    return jn.exclude_rows(logs(spark, sf_dir).select("id", "evil"), scored(spark, sf_dir).filter("score > 1"), "id")


@query("semi_rows", on_logs("SELECT id, sus FROM logs WHERE id IN (SELECT id FROM s WHERE score > 1)", s=SCORED_SQL))
def semi_rows(spark, sf_dir):
    return jn.semi_rows(logs(spark, sf_dir).select("id", "sus"), scored(spark, sf_dir).filter("score > 1"), "id")


@query("semi_share", on_logs("SELECT count(*) FILTER (WHERE score > 1) AS found, count(*) AS n, round(count(*) FILTER (WHERE score > 1) * 100.0 / count(*), 6) AS percent FROM s WHERE sus = 1", s=SCORED_SQL))
def semi_share(spark, sf_dir):
    return rounded(jn.semi_share(logs(spark, sf_dir).filter("sus = 1"), scored(spark, sf_dir).filter("score > 1"), "id"))


@query(
    "union_classes",
    on_logs(
        "SELECT class, coalesce(a.n, 0) AS n_a, coalesce(round(a.n * 100.0 / sum(a.n) OVER (), 6), 0) AS percent_a, coalesce(b.n, 0) AS n_b, coalesce(round(b.n * 100.0 / sum(b.n) OVER (), 6), 0) AS percent_b FROM (SELECT processName AS class, count(*) AS n FROM logs GROUP BY 1) a FULL JOIN (SELECT processName AS class, count(*) AS n FROM logs WHERE evil = 0 GROUP BY 1) b USING (class)"
    ),
)
def union_classes(spark, sf_dir):
    df = logs(spark, sf_dir)
    return rounded(jn.union_classes(df, df.filter("evil = 0"), "processName"))


METHODS = ["host-0", "host-1", "host-2", "host-3"]
METRIC_SQL = "SELECT hostName AS method, 'ratio' AS metric, round(avg(evil), 6) AS value FROM logs GROUP BY 1 UNION ALL SELECT hostName, 'shift', round(avg(returnValue), 6) FROM logs GROUP BY 1"


def method_metrics(spark, sf_dir):
    g = logs(spark, sf_dir).groupBy(F.col("hostName").alias("method")).agg(F.round(F.avg("evil"), 6).alias("ratio"), F.round(F.avg("returnValue"), 6).alias("shift"))
    return g.unpivot(["method"], ["ratio", "shift"], "metric", "value")


@query("method_comparison", on_logs("SELECT metric, " + ", ".join(f"max(value) FILTER (WHERE method = '{m}') AS \"{m}\"" for m in METHODS) + " FROM v GROUP BY metric", v=METRIC_SQL))
def method_comparison(spark, sf_dir):
    return jn.method_comparison(method_metrics(spark, sf_dir), METHODS)


@query("best_method", on_logs("SELECT method, round(sum(abs(value)), 6) AS total FROM v GROUP BY 1 ORDER BY sum(abs(value)), method LIMIT 1", v=METRIC_SQL))
def best_method(spark, sf_dir):
    return rounded(jn.best_method(method_metrics(spark, sf_dir), ["ratio", "shift"]))
