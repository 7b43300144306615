"""Fitted models over the whole log: components, clusterings, trees, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddrows.checks.base import BASE_COLS, logs, on_logs, query, rounded
from oddrows.checks.neighbors import XS, vectors
from oddrows.models import clustering as cl
from oddrows.models import common
from oddrows.models import isolation, linear, nets, svm
from oddrows.models import trees as tr
from oddrows.operators import features as ft
from oddrows.operators import metrics as mt
from oddrows.session import cut_lineage, scratch_path

COLS = list(BASE_COLS)
RAW = ["amount", "returnValue", "argsNum", "processId", "parentProcessId"]


def base(spark, sf_dir):
    return ft.base_features(logs(spark, sf_dir))


def raw(spark, sf_dir):
    return logs(spark, sf_dir).select("id", *[F.col(c).cast("double").alias(c) for c in RAW], "sus", "evil")


# --- components ----------------------------------------------------------------------------------

COV = "SELECT var_samp(amount) AS a, var_samp(returnValue) AS b, covar_samp(amount, returnValue) AS c, avg(amount) AS ma, avg(returnValue) AS mb FROM logs"
EIG = "SELECT *, (a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 AS l FROM cov"


@query("pca_two_columns", on_logs("SELECT round(l / (a + b), 6) AS ratio_0, round(1 - l / (a + b), 6) AS ratio_1 FROM eig", cov=COV, eig=EIG))
def pca_two_columns(spark, sf_dir):
    model = linear.pca_fit(logs(spark, sf_dir), ["amount", "returnValue"], 2)
    return rounded(spark.createDataFrame([tuple(float(r) for r in model.ratio)], "ratio_0 double, ratio_1 double"))


AXIS = """SELECT *, v1 / sqrt(v1 * v1 + v2 * v2) * s AS x, v2 / sqrt(v1 * v1 + v2 * v2) * s AS y FROM (
  SELECT *, CASE WHEN CASE WHEN abs(v1) >= abs(v2) THEN v1 ELSE v2 END < 0 THEN -1 ELSE 1 END AS s FROM (
    SELECT *, CASE WHEN a > b THEN l - b ELSE c END AS v1, CASE WHEN a > b THEN c ELSE l - a END AS v2 FROM eig))"""
# the second axis is the first one turned, its largest loading positive
AXES = """SELECT 0 AS component, l / (a + b) AS r, x AS amount, y AS returnValue FROM axis UNION ALL
  SELECT 1, 1 - l / (a + b), -y * t, x * t FROM (SELECT *, CASE WHEN CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END < 0 THEN -1 ELSE 1 END AS t FROM axis)"""
LOADINGS = """SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC) AS INT) AS rank, feature,
  round(loading, 6) AS loading, round(r, 6) AS variance_ratio
  FROM (SELECT component, r, 'amount' AS feature, amount AS loading FROM axes UNION ALL SELECT component, r, 'returnValue', returnValue FROM axes)"""


def two_axes(spark, sf_dir):
    return linear.pca_fit(logs(spark, sf_dir), ["amount", "returnValue"], 2)


@query("pca_loadings_two_columns", on_logs(LOADINGS, cov=COV, eig=EIG, axis=AXIS, axes=AXES))
def pca_loadings_two_columns(spark, sf_dir):
    return rounded(linear.pca_loadings(spark, two_axes(spark, sf_dir), 2))


@query("pca_importance_two_columns", on_logs("SELECT 'amount' AS feature, round(sum(abs(amount)), 6) AS importance FROM axes UNION ALL SELECT 'returnValue', round(sum(abs(returnValue)), 6) FROM axes", cov=COV, eig=EIG, axis=AXIS, axes=AXES))
def pca_importance_two_columns(spark, sf_dir):
    return rounded(linear.pca_importance(spark, two_axes(spark, sf_dir)))


PROJECTED = """SELECT id, evil, round((logs.amount - ma) * p.amount + (logs.returnValue - mb) * p.returnValue, 4) + 0.0 AS pc_0,
  round((logs.amount - ma) * q.amount + (logs.returnValue - mb) * q.returnValue, 4) + 0.0 AS pc_1
  FROM logs, cov, axes p, axes q WHERE p.component = 0 AND q.component = 1"""


@query("project_2d_two_columns", on_logs(PROJECTED, cov=COV, eig=EIG, axis=AXIS, axes=AXES))
def project_2d_two_columns(spark, sf_dir):
    from oddrows.plans.studies import project_2d

    return rounded(project_2d(logs(spark, sf_dir).select("id", "evil", F.col("amount").cast("double"), F.col("returnValue").cast("double")), ["amount", "returnValue"], 2, ["id", "evil"]), 4)


# one axis kept: the error is the squared distance to the axis
@query(
    "pca_score",
    on_logs(
        "SELECT id, round(power((amount - ma) * v2 - (returnValue - mb) * v1, 2) / (v1 * v1 + v2 * v2), 4) AS reconstruction_error FROM logs, (SELECT ma, mb, CASE WHEN a > b THEN l - b ELSE c END AS v1, CASE WHEN a > b THEN c ELSE l - a END AS v2 FROM eig)",
        cov=COV,
        eig=EIG,
    ),
)
def pca_score(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", "amount", F.col("returnValue").cast("double").alias("returnValue"))
    model = linear.pca_fit(df, ["amount", "returnValue"], 1)
    return rounded(linear.pca_score(df, model).select("id", "reconstruction_error"), 4)


@query("pca_fit")
def pca_fit(spark, sf_dir):
    return linear.pca_loadings(spark, linear.pca_fit(vectors(spark, sf_dir), XS, 6), top=64)


@query("pca_transform")
def pca_transform(spark, sf_dir):
    df = base(spark, sf_dir)
    return linear.pca_transform(df, linear.pca_fit(df, COLS, 3)).select("id", "pc_0", "pc_1", "pc_2")


@query("pca_inverse")
def pca_inverse(spark, sf_dir):
    df = base(spark, sf_dir)
    model = linear.pca_fit(df, COLS, 3)
    return linear.pca_inverse(linear.pca_transform(df, model), model).select("id", *COLS)


@query("pca_loadings")
def pca_loadings(spark, sf_dir):
    return linear.pca_loadings(spark, linear.pca_fit(base(spark, sf_dir), COLS, 3))


@query("pca_importance")
def pca_importance(spark, sf_dir):
    return linear.pca_importance(spark, linear.pca_fit(base(spark, sf_dir), COLS, 5))


@query("center_contribution")
def center_contribution(spark, sf_dir):
    df = base(spark, sf_dir)
    model = linear.pca_fit(df, COLS, 3)
    center = linear.pca_transform(df.filter("evil = 1"), model).agg(*[F.avg(f"pc_{i}") for i in range(3)]).first()
    return linear.center_contribution(spark, model, list(center))


@query("onehot_svd")
def onehot_svd(spark, sf_dir):
    return linear.onehot_svd(logs(spark, sf_dir).select("id", "eventName", "hostName"), ["eventName", "hostName"], 8)


@query(
    "mca",
    on_logs("SELECT id, round(n / c - 1, 6) AS norm FROM logs JOIN (SELECT eventName, count(*) AS c FROM logs GROUP BY 1) USING (eventName), (SELECT count(*) AS n FROM logs)"),
)
def mca_one(spark, sf_dir):
    """One column, all axes: the squared norm of a row is n / (rows of its category) - 1."""
    df = linear.mca(logs(spark, sf_dir).select("id", "eventName"), ["eventName"], 4, "m_")
    norm = sum((F.col(c) * F.col(c) for c in df.columns if c.startswith("m_")), F.lit(0.0))
    return rounded(df.select("id", norm.alias("norm")))


@query("mca_columns")
def mca_columns(spark, sf_dir):
    return linear.mca(logs(spark, sf_dir).select("id", "eventName", "hostName", "processName"), ["eventName", "hostName"], 5, "m_")


# --- clusterings ---------------------------------------------------------------------------------


def by_cluster(rows, cols):
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])


@query("kmeans")
def kmeans(spark, sf_dir):
    rows, _ = cl.kmeans(base(spark, sf_dir), COLS, 8, "id")
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("evil").alias("evil_n"), F.sum(F.col("distance") * F.col("distance")).alias("cost"))


@query("kmeans_vectors")
def kmeans_vectors(spark, sf_dir):
    rows, _ = cl.kmeans(vectors(spark, sf_dir), XS, 10, "vec_id")
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("distance").alias("distance"))


@query("gmm")
def gmm(spark, sf_dir):
    rows = cl.gmm(base(spark, sf_dir), COLS, 3, "id")
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("log_likelihood").alias("log_likelihood"))


@query("fuzzy_cmeans")
def fuzzy_cmeans(spark, sf_dir):
    rows, _ = cl.fuzzy_cmeans(base(spark, sf_dir), COLS, 3, "id")
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("max_membership").alias("max_membership"))


@query("hierarchical")
def hierarchical(spark, sf_dir):
    rows, _ = cl.hierarchical(base(spark, sf_dir), COLS, 6, "id")
    return by_cluster(rows, COLS)


# --- trees ---------------------------------------------------------------------------------------

TREE_COLS = ["amount", "returnValue", "argsNum", "processId", "sus"]


def fitted(spark, sf_dir, kind="tree", **kw):
    df = raw(spark, sf_dir)
    return df, tr.tree_model(df, TREE_COLS, "evil", kind, **kw)


WEIGHTS = "SELECT id, round(CASE WHEN max(c) OVER () / min(c) OVER () > 10 THEN n / (k * c) ELSE 1 END, 6) AS weight FROM (SELECT id, count(*) OVER (PARTITION BY cls) AS c, count(*) OVER () AS n FROM (SELECT id, CASE WHEN evil = 1 THEN 2 WHEN sus = 1 THEN 1 ELSE 0 END AS cls FROM logs)), (SELECT 3 AS k)"


@query("balanced_weights", on_logs(WEIGHTS))
def balanced_weights(spark, sf_dir):
    df = logs(spark, sf_dir).select("id", F.when(F.col("evil") == 1, 2).when(F.col("sus") == 1, 1).otherwise(0).alias("cls"))
    return rounded(tr.balanced_weights(df, "cls").select("id", "weight"))


@query("tree_model")
def tree_model(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "tree")
    return mt.binary_report(tr.predict(df, t), "evil", "pred")


@query("forest_model")
def forest_model(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "forest")
    return tr.predict(df, t).select("id", "score", "pred")


@query("mdi_importance")
def mdi_importance(spark, sf_dir):
    _, t = fitted(spark, sf_dir, "forest")
    return tr.mdi_importance(spark, t)


ABS_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, sus)), 6) AS importance FROM logs" for c in RAW)


@query("select_above_median", on_logs("SELECT * FROM c WHERE importance > (SELECT quantile_cont(importance, 0.5) FROM c)", c=ABS_CORR))
def select_above_median(spark, sf_dir):
    one = raw(spark, sf_dir).agg(*[F.round(F.abs(F.corr(c, "sus")), 6).alias(c) for c in RAW])
    return tr.select_above_median(one.unpivot([], RAW, "feature", "importance"))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "tree")
    return tr.permutation_importance(df, t, "id")


@query("shap_importance")
def shap_importance(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "forest")
    return tr.shap_importance(df, t)


@query("tree_rules")
def tree_rules(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "tree")
    return tr.tree_rules(df, t)


@query("tree_thresholds")
def tree_thresholds(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "tree")
    return tr.tree_thresholds(df, t)


@query("forest_usage")
def forest_usage(spark, sf_dir):
    _, t = fitted(spark, sf_dir, "forest")
    return tr.forest_usage(spark, t)


@query("forest_leaf_rows")
def forest_leaf_rows(spark, sf_dir):
    df, t = fitted(spark, sf_dir, "forest")
    return tr.leaf_rows(df, t)


@query("baseline_model")
def baseline_model(spark, sf_dir):
    return tr.baseline_report(raw(spark, sf_dir), [*RAW, "sus"], "evil", "id")


# --- detectors -----------------------------------------------------------------------------------


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    df = base(spark, sf_dir)
    return isolation.isolation_forest(df, COLS, "id", fit_on=ft.train_filter_benign(df)).select("id", "score")


@query("one_class_svm")
def one_class_svm(spark, sf_dir):
    df = base(spark, sf_dir)
    return svm.one_class_svm(df, COLS, "id", fit_on=ft.train_filter_benign(df)).select("id", "score")


@query("autoencoder")
def autoencoder(spark, sf_dir):
    df = base(spark, sf_dir)
    net = nets.autoencoder_fit(ft.train_filter_benign(df), COLS, "id", latent=3)
    return nets.autoencoder_score(df, net, codes=True).select("id", "reconstruction_error", "latent_1", "latent_2", "latent_3")


@query("autoencoder_validation")
def autoencoder_validation(spark, sf_dir):
    df = ft.train_filter_benign(base(spark, sf_dir))
    _, errors = nets.fit_with_validation(df, COLS, "id", nets.autoencoder_fit, latent=3)
    return errors


@query("vae")
def vae(spark, sf_dir):
    df = base(spark, sf_dir)
    net = nets.vae_fit(ft.train_filter_benign(df), COLS, "id", latent=3)
    return nets.vae_score(df, net).select("id", "reconstruction_error", "kl_divergence", "total_loss", "latent_variance_mean")


@query("vae_generate")
def vae_generate(spark, sf_dir):
    df = cut_lineage(ft.train_filter_benign(base(spark, sf_dir)))
    net = nets.vae_fit(df, COLS, "id", latent=3)
    made = nets.generate(spark, net, df.count())
    tag = lambda d, name: d.select(*COLS).withColumn("kind", F.lit(name))
    both = tag(df, "observed").unionByName(tag(made, "generated"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in COLS], *[F.stddev_pop(c).alias(f"{c}_std") for c in COLS])


@query("save_model", on_logs("SELECT count(*) AS n, 0 AS changed FROM logs"))
def save_tree_model(spark, sf_dir):
    """A fitted forest written by Spark's own writer and read back predicts the same classes."""
    from pyspark.ml.classification import RandomForestClassificationModel

    df, t = fitted(spark, sf_dir, "forest")
    path = scratch_path(spark, "forest")
    t.model.write().save(path)
    again = tr.Trees(t.cols, t.label, RandomForestClassificationModel.load(path), t.kind)
    both = tr.predict(tr.predict(df, t, "score_a", "pred_a"), again, "score_b", "pred_b")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("pred_a") != F.col("pred_b")).alias("changed"))


@query("save_load_model", on_logs("SELECT count(*) AS n, CAST(0 AS DOUBLE) AS largest_gap FROM logs"))
def save_load_model(spark, sf_dir):
    """Parameters written and read back score the same rows."""
    df = base(spark, sf_dir)
    net = nets.autoencoder_fit(ft.train_filter_benign(df), COLS, "id", latent=2)
    path = common.save_model(spark, nets.net_params(net), scratch_path(spark, "net"))
    again = nets.net_from_params(COLS, common.load_model(spark, path))
    both = nets.autoencoder_score(nets.autoencoder_score(df, net, "before"), again, "after")
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_gap"))
