"""Plot data, reductions and end-to-end studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import SCORED_SQL, logs, on_logs, query, rounded, scored
from oddrows.checks.models import COLS, RAW, base, raw
from oddrows.checks.profile import CLASS, union_of
from oddrows.checks.sampling import ranked
from oddrows.operators import features as ft
from oddrows.operators import plotdata as pt
from oddrows.operators import profile as pf
from oddrows.operators import sampling as sp
from oddrows.models.linear import mca
from oddrows.models.trees import mdi_importance, tree_model
from oddrows.plans import reduction as rd
from oddrows.plans import studies as sd
from oddrows.session import cut_lineage
from oddrows.sources.logs import tag_splits

# --- plot data -----------------------------------------------------------------------------------

CLASSED = f"SELECT {CLASS} AS class, score FROM s"


def classed(spark, sf_dir):
    return ft.class3(scored(spark, sf_dir))


def hist_sql(bins, hi):
    return f"""SELECT class, CAST(least({bins - 1}, floor((score - lo) / (hi - lo) * {bins})) AS INT) AS bin, count(*) AS n, max(lo) AS lo, max((hi - lo) / {bins}) AS width
      FROM k, (SELECT min(score) AS lo, {hi} AS hi FROM k) WHERE score <= hi GROUP BY 1, 2"""


HIST_OUT = 'SELECT class, bin, round(lo + bin * width, 6) AS "left", n, round(n / sum(n) OVER (PARTITION BY class) / width, 6) AS density FROM h'


@query("hist_by_class", on_logs(HIST_OUT, s=SCORED_SQL, k=CLASSED, h=hist_sql(50, "max(score)")))
def hist_by_class(spark, sf_dir):
    return rounded(pt.hist_by_class(classed(spark, sf_dir), "score", "class"))


@query("hist_by_class_p99", on_logs(HIST_OUT, s=SCORED_SQL, k=CLASSED, h=hist_sql(100, "quantile_cont(score, 0.99)")))
def hist_by_class_p99(spark, sf_dir):
    return rounded(pt.hist_by_class(classed(spark, sf_dir), "score", "class", bins=100, upper_pct=99))


@query(
    "kde_curve",
    on_logs(
        "SELECT class, round(x, 6) AS x, round(sum(w * exp(-0.5 * power((x - v) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM vals JOIN st USING (class), grid GROUP BY class, x",
        s=SCORED_SQL,
        k=CLASSED,
        vals="SELECT class, score AS v, count(*) AS w FROM k GROUP BY 1, 2",
        st="SELECT class, count(*) AS n, stddev_samp(score) * power(count(*), -0.2) AS h FROM k GROUP BY class",
        grid="SELECT lo + i * ((hi - lo) / 39) AS x FROM (SELECT min(score) AS lo, max(score) AS hi FROM k), (SELECT unnest(range(40)) AS i)",
    ),
)
def kde_curve(spark, sf_dir):
    return rounded(pt.kde_curve(classed(spark, sf_dir), "score", "class", points=40))


@query(
    "box_violin_summary",
    on_logs(
        "SELECT class, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS low_whisker, round(max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS high_whisker, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT class, ln(1 + score) AS v FROM k) JOIN (SELECT class, quantile_cont(ln(1 + score), 0.25) AS q1, quantile_cont(ln(1 + score), 0.5) AS median, quantile_cont(ln(1 + score), 0.75) AS q3 FROM k GROUP BY class) USING (class) GROUP BY class, q1, median, q3",
        s=SCORED_SQL,
        k=CLASSED,
    ),
)
def box_violin_summary(spark, sf_dir):
    return rounded(pt.box_violin_summary(classed(spark, sf_dir), "class", "score", log1p=True))


@query("scatter_sample", on_logs(f"SELECT id, {CLASS} AS class, amount, returnValue FROM ranked WHERE r <= 2000", ranked=ranked(42)))
def scatter_sample(spark, sf_dir):
    df = ft.class3(logs(spark, sf_dir))
    return pt.scatter_sample(df, ["amount", "returnValue"], "id", ["class"], 2000)


def _unit(seed):
    return f"CAST(CAST('0x' || substr(md5('{seed}:' || id), 1, 13) AS BIGINT) AS DOUBLE)"


JITTER = ", ".join(
    f"round({c} + 0.1 * sqrt(-2 * ln(({_unit(43 + 2 * i)} + 1) / power(2, 52))) * cos(2 * pi() * ({_unit(44 + 2 * i)} / power(2, 52))), 6) AS {c}"
    for i, c in enumerate(["amount", "returnValue"])
)


@query("scatter_sample_jitter", on_logs(f"SELECT id, {CLASS} AS class, {JITTER} FROM ranked WHERE r <= 2000", ranked=ranked(42)))
def scatter_sample_jitter(spark, sf_dir):
    return rounded(pt.scatter_sample(ft.class3(logs(spark, sf_dir)), ["amount", "returnValue"], "id", ["class"], 2000, jitter=0.1))


# a settings grid made of log groups: process x arguments x parent, with ratios standing in for scores
GRID = "SELECT processName AS algorithm, CAST(argsNum AS INT) AS pca_dim, CAST(parentProcessId AS INT) AS n_clusters, CAST(id % 2 AS INT) AS trial, avg(amount) AS silhouette, round(sum(amount), 4) AS inertia FROM logs GROUP BY 1, 2, 3, 4"


def grid(spark, sf_dir):
    df = logs(spark, sf_dir)
    return df.groupBy(
        F.col("processName").alias("algorithm"), F.col("argsNum").cast("int").alias("pca_dim"), F.col("parentProcessId").cast("int").alias("n_clusters"), (F.col("id") % 2).cast("int").alias("trial")
    ).agg(F.avg("amount").alias("silhouette"), F.round(F.sum("amount"), 4).alias("inertia"))


@query("grid_matrix", on_logs("SELECT pca_dim, " + ", ".join(f'round(avg(silhouette) FILTER (WHERE n_clusters = {i}), 6) AS "{i}"' for i in range(10)) + " FROM g GROUP BY pca_dim", g=GRID))
def grid_matrix(spark, sf_dir):
    return rounded(pt.grid_matrix(grid(spark, sf_dir), "pca_dim", "n_clusters", "silhouette", range(10)))


CELLS = "SELECT pca_dim, n_clusters, avg(silhouette) AS v FROM g GROUP BY 1, 2"
TOP = "SELECT pca_dim AS d, n_clusters AS k FROM c ORDER BY v DESC, pca_dim, n_clusters LIMIT 1"


@query("best_slices", on_logs("SELECT 'best row' AS slice, n_clusters AS position, round(v, 6) AS value FROM c, t WHERE pca_dim = d UNION ALL SELECT 'best column', pca_dim, round(v, 6) FROM c, t WHERE n_clusters = k", g=GRID, c=CELLS, t=TOP))
def best_slices(spark, sf_dir):
    return rounded(pt.best_slices(grid(spark, sf_dir), "pca_dim", "n_clusters", "silhouette"))


@query("project_2d")
def project_2d(spark, sf_dir):
    return sd.project_2d(base(spark, sf_dir), COLS, 2, ["id", "evil"])


# --- grids ---------------------------------------------------------------------------------------


@query(
    "best_params",
    on_logs(
        "SELECT algorithm, n_clusters, pca_dim, round(s, 6) AS silhouette, round(CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (n_clusters - 2), 6) + 0.0 AS eps FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY s DESC, pca_dim, n_clusters) AS r FROM (SELECT algorithm, pca_dim, n_clusters, avg(silhouette) AS s FROM g GROUP BY 1, 2, 3)) WHERE r = 1",
        g=GRID,
    ),
)
def best_params(spark, sf_dir):
    return rounded(sd.best_params(grid(spark, sf_dir)))


@query(
    "best_inertia_dim",
    on_logs("SELECT pca_dim, round(sum(i), 4) AS inertia FROM (SELECT pca_dim, n_clusters, avg(inertia) AS i FROM g GROUP BY 1, 2) GROUP BY 1 ORDER BY sum(i), pca_dim LIMIT 1", g=GRID),
)
def best_inertia_dim(spark, sf_dir):
    return rounded(sd.best_inertia_dim(grid(spark, sf_dir)), 4)


# squares within k equal-width bins of the amount: a falling, convex curve
CURVE = " UNION ALL ".join(
    f"SELECT {k} AS x, round(sum(n * v), 2) AS y FROM (SELECT count(*) AS n, var_pop(amount) AS v FROM logs, (SELECT min(amount) AS lo, max(amount) AS hi FROM logs) GROUP BY least({k}, greatest(1, ceil((amount - lo) / ((hi - lo) / {k})))))"
    for k in range(1, 16)
)


def curve(spark, sf_dir):
    df = cut_lineage(logs(spark, sf_dir).select("amount"))
    out = None
    for k in range(1, 16):
        bins = ft.cut_equal_width(df, "amount", k).groupBy("bin").agg(F.count("*").alias("n"), F.var_pop("amount").alias("v"))
        row = bins.agg(F.lit(k).alias("x"), F.round(F.sum(F.col("n") * F.col("v")), 2).alias("y"))
        out = row if out is None else out.unionByName(row)
    return out


# knee: the last peak of the difference curve before it falls a mean step below that peak
KNEEDLE = dict(
    c=CURVE,
    n="SELECT x, y, (x - 1) / 14 AS xn, 1 - (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS yn FROM c",
    d="SELECT *, yn - xn AS d, coalesce(lag(yn - xn) OVER w, yn - xn) AS p, coalesce(lead(yn - xn) OVER w, yn - xn) AS q, lead(yn - xn) OVER w AS nxt FROM n WINDOW w AS (ORDER BY x)",
    m="SELECT *, max(CASE WHEN d >= p AND d >= q THEN x END) OVER w AS top, max(CASE WHEN d <= p AND d <= q THEN x END) OVER w AS low FROM d WINDOW w AS (ORDER BY x)",
    f="SELECT m.x, m.top FROM m JOIN d t ON t.x = m.top WHERE m.nxt < CASE WHEN coalesce(m.low, 0) >= m.top THEN 0 ELSE t.d - 1 / 14 END",
)


@query("elbow", on_logs("SELECT CAST(arg_min(top, x) AS DOUBLE) AS elbow, CAST(1 AS INT) AS is_knee FROM f", **KNEEDLE))
def elbow(spark, sf_dir):
    return sd.elbow(curve(spark, sf_dir), "x", "y")


@query("label_clusters", on_logs("SELECT userId AS cluster, CAST(avg(evil) > 0.2 AS INT) AS verdict FROM logs GROUP BY 1"))
def label_clusters(spark, sf_dir):
    return sd.label_clusters(logs(spark, sf_dir), "userId")


SHIFT3 = union_of(
    ["amount", "returnValue", "argsNum"],
    "SELECT 'shift' AS section, '{c}' AS name, abs(a.m - b.m) * (1 + abs(1 - a.s / (b.s + 1e-10))) AS value FROM (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM k WHERE cluster = 1010) a, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM k WHERE cluster <> 1010) b",
)


@query(
    "investigate_cluster",
    on_logs(
        f"SELECT section, name, round(value, 6) AS value FROM (SELECT 'size' AS section, unnest(['size', 'evil', 'evil_percent']) AS name, unnest([CAST(count(*) AS DOUBLE), CAST(sum(evil) AS DOUBLE), avg(evil) * 100]) AS value FROM k WHERE cluster = 1010 UNION ALL {SHIFT3} UNION ALL SELECT * FROM (SELECT 'center distance', CAST(b.cluster AS VARCHAR), sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS dd FROM c a, c b WHERE a.cluster = 1010 AND b.cluster <> 1010 ORDER BY dd, b.cluster LIMIT 3))",
        k="SELECT *, eventId AS cluster FROM logs",
        c="SELECT cluster, avg(amount) AS x, avg(returnValue) AS y, avg(argsNum) AS z FROM k GROUP BY cluster",
    ),
)
def investigate_cluster(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn("cluster", F.col("eventId"))
    return rounded(sd.investigate_cluster(df, ["amount", "returnValue", "argsNum"], 1010, k=3))


@query("cluster_features")
def cluster_features(spark, sf_dir):
    df = logs(spark, sf_dir)
    tagged = tag_splits({"train": df.filter("id % 10 < 6"), "validation": df.filter("id % 10 BETWEEN 6 AND 7"), "test": df.filter("id % 10 > 7")})
    return sd.cluster_features(tagged, "id")[0]


def _detect(kind, **kw):
    def run(spark, sf_dir):
        return sd.detect(base(spark, sf_dir), kind, COLS, "id", **kw)[1]

    return run


@query("detect")
def detect(spark, sf_dir):
    """Two detectors side by side."""
    df = cut_lineage(base(spark, sf_dir))
    return sd.detect(df, "pca", COLS, "id")[1].unionByName(sd.detect(df, "isolation", COLS, "id")[1])


query("detect_pca")(_detect("pca"))
query("detect_isolation")(_detect("isolation"))
query("detect_svm")(_detect("svm"))
query("detect_autoencoder")(_detect("autoencoder", latent=3))
query("detect_vae")(_detect("vae", latent=3))


def split_sizes(df):
    """Clustering 40 %, labelling 40 %, test 20 % of all rows."""
    n = df.count()
    return {"cluster": int(n * 0.4), "label": int(n * 0.4), "test": n - 2 * int(n * 0.4)}


@query("cluster_then_classify")
def cluster_then_classify(spark, sf_dir):
    """Density clusters on the correspondence axes of the event id."""
    df = cut_lineage(mca(logs(spark, sf_dir).select("id", "eventId", "evil"), ["eventId"], 4, "eventId_MCA_"))
    return sd.cluster_then_classify(df, [f"eventId_MCA_{i}" for i in range(4)], "id", split_sizes(df), "dbscan", eps=0.5, min_samples=20, vary="all", repeats=2)


@query("cluster_then_classify_dbscan")
def cluster_then_classify_dbscan(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    return sd.cluster_then_classify(df, COLS, "id", split_sizes(df), "dbscan", eps=0.5, min_samples=20, dims=5, repeats=2)


@query("cluster_then_classify_kmeans")
def cluster_then_classify_kmeans(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    return sd.cluster_then_classify(df, COLS, "id", split_sizes(df), "kmeans", k=8, dims=5, repeats=2, predictor="distance")


@query("internal_grid")
def internal_grid(spark, sf_dir):
    return sd.internal_grid(base(spark, sf_dir), COLS, "id", "evil", [2, 3, 5], [2, 3, 5, 8, 12], ["kmeans", "hierarchical", "dbscan", "gmm", "fcm"])


@query("external_eval")
def external_eval(spark, sf_dir):
    return sd.external_eval(base(spark, sf_dir), COLS, "id", "evil", "hierarchical", 4, 3)


@query("external_eval_kmeans")
def external_eval_kmeans(spark, sf_dir):
    return sd.external_eval(base(spark, sf_dir), COLS, "id", "evil", "kmeans", 8, 3)


@query("external_eval_gmm")
def external_eval_gmm(spark, sf_dir):
    return sd.external_eval(base(spark, sf_dir), COLS, "id", "evil", "gmm", 3, 3)


@query("external_eval_fcm")
def external_eval_fcm(spark, sf_dir):
    return sd.external_eval(base(spark, sf_dir), COLS, "id", "evil", "fcm", 3, 3)


@query("dbscan_grid")
def dbscan_grid(spark, sf_dir):
    return sd.dbscan_grid(base(spark, sf_dir), COLS, "id", "evil", [3, 4, 5, 6], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [5, 10, 15, 20, 50])


@query("evil_cluster_tests")
def evil_cluster_tests(spark, sf_dir):
    df = base(spark, sf_dir)
    df = cut_lineage(df.join(logs(spark, sf_dir).select("id", F.col("eventName"), "amount"), "id").withColumn("cluster", F.when(F.col("eventName") == "error", 1).otherwise(0)))
    return sd.evil_cluster_tests(df, [*COLS, "amount"], sd.label_clusters(df))


@query("eda_summary")
def eda_summary(spark, sf_dir):
    df = raw(spark, sf_dir)
    model = tree_model(df, RAW, "evil", "forest")
    return pf.eda_summary(logs(spark, sf_dir), "userId", "evil", mdi_importance(spark, model), cut=0.25)


# --- reduction -----------------------------------------------------------------------------------


@query("kmeans_representative_sample")
def kmeans_representative_sample(spark, sf_dir):
    return rd.kmeans_representative_sample(base(spark, sf_dir), COLS, "evil", "id", 500)


QUOTAS = "SELECT 1 AS evil, CAST(floor({n} * (sum(evil) / count(*))) AS BIGINT) AS n FROM logs UNION ALL SELECT 0, CAST({n} - floor({n} * (sum(evil) / count(*))) AS BIGINT) FROM logs"


@query("kmeans_sample_classes", on_logs(QUOTAS.format(n=500)))
def kmeans_sample_classes(spark, sf_dir):
    """The representative sample holds the quota of each class, no row twice."""
    rows = kmeans_representative_sample(spark, sf_dir)
    return rows.groupBy("evil").agg(F.count_distinct("id").alias("n"))


@query("density_sample_classes", on_logs(QUOTAS.format(n=2000)))
def density_sample_classes(spark, sf_dir):
    """The density sample has the class ratio of the table; a copy of a row counts as a row."""
    return density_sample(spark, sf_dir).groupBy("evil").agg(F.count_distinct("id", "copy").alias("n"))


SAMPLED = """SELECT logs.* FROM logs JOIN (
  SELECT id FROM ranked, (SELECT count(*) AS n, sum(evil) AS p FROM logs)
  WHERE r <= CASE WHEN evil = 1 THEN floor(1500 * (p / n)) ELSE 1500 - floor(1500 * (p / n)) END) USING (id)"""
SHARE = "SELECT (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 / (a + b) AS r FROM (SELECT var_samp(amount) AS a, var_samp(returnValue) AS b, covar_samp(amount, returnValue) AS c FROM {t})"


@query(
    "pca_variance_diff_two_columns",
    on_logs(f"SELECT round(2 * abs(a.r - b.r), 6) AS pca_variance_diff FROM ({SHARE.format(t='logs')}) a, ({SHARE.format(t='sampled')}) b", ranked=ranked(42, "evil"), sampled=SAMPLED),
)
def pca_variance_diff_two_columns(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", "evil", F.col("amount").cast("double"), F.col("returnValue").cast("double"))
    gap = rd.pca_variance_diff(df, sp.stratified_sample(df, "id", "evil", 1500), ["amount", "returnValue"])
    return rounded(spark.createDataFrame([(gap,)], "pca_variance_diff double"))


@query("density_sample")
def density_sample(spark, sf_dir):
    return rd.density_sample(base(spark, sf_dir), COLS, "evil", "id", 2000).select("id", "copy", "evil")


@query("pca_variance_diff")
def pca_variance_diff(spark, sf_dir):
    df = base(spark, sf_dir)
    gap = rd.pca_variance_diff(df, sp.stratified_sample(df, "id", "evil", 1500), COLS)
    return spark.createDataFrame([(gap,)], "pca_variance_diff double")


@query("model_auc_diff")
def model_auc_diff(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    ref = rd.forest_reference(df, COLS, "evil", "id")
    gaps = rd.model_auc_diff(sp.stratified_sample(df, "id", "evil", 1500), ref, COLS, "evil")
    return spark.createDataFrame(list(gaps.items()), "metric string, value double")


@query("anomaly_auc_diff")
def anomaly_auc_diff(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    ref = rd.isolation_reference(df, df, COLS, "evil", "id")
    gaps = rd.anomaly_auc_diff(sp.stratified_sample(df, "id", "evil", 1500), ref, COLS, "evil", "id")
    return spark.createDataFrame(list(gaps.items()), "metric string, value double")


@query("information_loss")
def information_loss(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    return rd.information_loss(df, sp.stratified_sample(df, "id", "evil", 1500), COLS, "evil", "id")


@query("reduce_and_compare")
def reduce_and_compare(spark, sf_dir):
    df = cut_lineage(base(spark, sf_dir))
    strata = logs(spark, sf_dir).select("id", "evil", "eventName")
    losses, best = rd.reduce_and_compare(df, COLS, "evil", "id", rd.default_samples(df, COLS, "evil", "id", 1500, strata))
    return losses.select("method", "metric", "value").unionByName(best.select("method", F.lit("total").alias("metric"), F.col("total").alias("value")))
