"""Reducing a table and measuring what is lost: representative and density samples, model-based losses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.models.clustering import kmeans
from oddrows.models.density import kde_logdensity
from oddrows.models.isolation import isolation_forest
from oddrows.models.linear import pca_fit
from oddrows.models.trees import predict, tree_model
from oddrows.operators import metrics as mt
from oddrows.operators.features import standardize
from oddrows.operators.infoloss import class_ratio_diff, divergences
from oddrows.operators.joins import best_method
from oddrows.operators.order import quantile_values
from oddrows.operators.sampling import adjust_class_ratio, stratified_quotas, stratified_sample, take_quotas, train_test
from oddrows.operators.topk import closest_to_center
from oddrows.session import cut_lineage


def kmeans_representative_sample(
    df: DataFrame, cols: Sequence[str], y: str, id_col: str, n: int, clusters: Mapping[int, int] | None = None, seed: int = 42
) -> DataFrame:
    """Per class, the row nearest to every k-means centre, as many centres as the class' quota.

    ``clusters`` may ask for fewer centres per class. Where centres or distinct points are fewer than the quota, rows in seeded
    order fill it.
    """
    clusters = clusters or {}
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    quotas = stratified_quotas(counts, n)
    reps = None
    for value, quota in quotas.items():
        if quota < 1:
            continue
        rows, _ = kmeans(df.filter(F.col(y) == value), cols, min(quota, clusters.get(value, quota)), id_col, seed)
        best = closest_to_center(rows.select("cluster", "distance", id_col), "cluster", "distance", id_col)
        # never more than the quota: the nearest representatives win
        part = best.orderBy("distance", id_col).limit(quota).select(id_col, F.lit(value).alias("_y"))
        reps = part if reps is None else reps.unionByName(part)
    reps = cut_lineage(reps)
    have = {r["_y"]: r["count"] for r in reps.groupBy("_y").count().collect()}
    rest = df.join(reps.select(id_col), id_col, "left_anti").select(*df.columns)
    more = take_quotas(rest, id_col, [y], lambda sizes: {g: quotas.get(g[0], 0) - have.get(g[0], 0) for g in sizes}, seed)
    return df.join(reps.select(id_col), id_col, "left_semi").select(*df.columns).unionByName(more)


def density_sample(df: DataFrame, cols: Sequence[str], y: str, id_col: str, n: int, bandwidth: float = 0.5, seed: int = 42) -> DataFrame:
    """Proportional sample from every decile of the kernel log-density, then forced to the class ratio (rows may repeat)."""
    scaled = standardize(df.select(id_col, y, *cols), cols)
    dens = cut_lineage(kde_logdensity(scaled, cols, id_col, bandwidth))
    edges = quantile_values(dens, ["log_density"], [i / 10 for i in range(1, 10)])["log_density"]
    decile = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("log_density")))
    binned = dens.select(id_col, y, decile.alias("_bin"))
    total = df.count()
    taken = take_quotas(binned, id_col, ["_bin"], lambda sizes: {g: int(c / total * n) for g, c in sizes.items()}, seed)
    share = df.agg(F.avg(y)).first()[0]
    final = adjust_class_ratio(cut_lineage(taken.select(id_col, y)), id_col, y, n, share, seed + 1)
    return df.join(final.select(id_col, "copy"), id_col).select(*df.columns, "copy")


# --- losses --------------------------------------------------------------------------------------


def pca_variance_diff(full: DataFrame, reduced: DataFrame, cols: Sequence[str], k: int = 5) -> float:
    k = min(k, len(cols))
    return float(np.abs(pca_fit(full, cols, k).ratio - pca_fit(reduced, cols, k).ratio).sum())


def _forest_areas(train: DataFrame, test: DataFrame, cols, y, trees, depth, seed):
    model = tree_model(train, cols, y, trees=trees, depth=depth, seed=seed)
    scored = predict(test, model)
    row = mt._areas(scored, "score", y, []).first()
    return row["roc_auc"], row["pr_auc"]


def forest_reference(full: DataFrame, cols: Sequence[str], y: str, id_col: str, trees: int = 100, depth: int = 10, seed: int = 42) -> dict:
    """Held-out rows and the areas of a forest fitted on the rest of the full table."""
    parts = cut_lineage(train_test(full.select(id_col, y, *cols), id_col, 0.2, y, seed))
    test = parts.filter("part = 'test'").drop("part")
    auc, pr = _forest_areas(parts.filter("part = 'train'"), test, cols, y, trees, depth, seed)
    return {"test": test, "auc": auc, "pr": pr}


def isolation_reference(full: DataFrame, test: DataFrame, cols: Sequence[str], y: str, id_col: str, seed: int = 42) -> dict:
    """Area of an isolation forest fitted on the full table, and the contamination clamped to [0.001, 0.2]."""
    scored = isolation_forest(test, cols, id_col, fit_on=full, seed=seed)
    share = full.agg(F.avg(y)).first()[0] or 0.0
    return {"test": test, "anomaly": mt.roc_auc(scored, "score", y).first()[0], "contamination": min(0.2, max(0.001, share))}


def reference_scores(full: DataFrame, cols: Sequence[str], y: str, id_col: str, trees: int = 100, depth: int = 10, seed: int = 42) -> dict:
    """The full-table side, fitted once and reused for every reduced set: held-out rows and their areas."""
    forest = forest_reference(full, cols, y, id_col, trees, depth, seed)
    return {**forest, **isolation_reference(full, forest["test"], cols, y, id_col, seed)}


def model_auc_diff(reduced: DataFrame, ref: dict, cols: Sequence[str], y: str, trees: int = 100, depth: int = 10, seed: int = 42) -> dict:
    """ROC and PR area of a forest trained on the reduced rows, against the full-table forest on the same test rows."""
    auc, pr = _forest_areas(reduced, ref["test"], cols, y, trees, depth, seed)
    return {"auc_diff": ref["auc"] - auc, "auc_orig": ref["auc"], "auc_red": auc, "pr_auc_diff": ref["pr"] - pr, "pr_auc_orig": ref["pr"], "pr_auc_red": pr}


def anomaly_auc_diff(reduced: DataFrame, ref: dict, cols: Sequence[str], y: str, id_col: str, seed: int = 42) -> dict:
    """Area of an isolation forest fitted on the reduced rows against the full-table one."""
    scored = isolation_forest(ref["test"], cols, id_col, fit_on=reduced, seed=seed)
    area = mt.roc_auc(scored, "score", y).first()[0]
    return {
        "anomaly_auc_diff": ref["anomaly"] - area, "anomaly_auc_orig": ref["anomaly"], "anomaly_auc_red": area, "contamination": ref["contamination"],
    }


def information_loss(
    full: DataFrame, reduced: DataFrame, cols: Sequence[str], y: str, id_col: str, ref: dict | None = None, trees: int = 100, depth: int = 10, seed: int = 42
) -> DataFrame:
    """All losses of one reduced set as ``(metric, value)`` rows."""
    ref = ref or reference_scores(full, cols, y, id_col, trees, depth, seed)
    reduced = cut_lineage(reduced)
    d = divergences(full, reduced, cols).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("kl", "js") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    ).first()
    ratio = class_ratio_diff(full, reduced, y).first()["class_ratio_diff"]
    values = {
        **{k: d[k] for k in d.asDict()},
        "class_ratio_diff": ratio,
        "pca_variance_diff": pca_variance_diff(full, reduced, cols),
        **model_auc_diff(reduced, ref, cols, y, trees, depth, seed),
        **anomaly_auc_diff(reduced, ref, cols, y, id_col, seed),
    }
    return full.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


JUDGED = ("avg_kl", "avg_js", "class_ratio_diff", "pca_variance_diff", "auc_diff", "pr_auc_diff", "anomaly_auc_diff")


def reduce_and_compare(
    df: DataFrame, cols: Sequence[str], y: str, id_col: str, samples: Mapping[str, DataFrame], trees: int = 100, depth: int = 10, seed: int = 42, signed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Losses of several named samples ``(method, metric, value)`` and the best method. The full side is fitted once."""
    ref = reference_scores(df, cols, y, id_col, trees, depth, seed)
    out = None
    for name, sample in samples.items():
        part = information_loss(df, sample, cols, y, id_col, ref, trees, depth, seed).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out, best_method(out, JUDGED, signed)


def default_samples(df: DataFrame, cols: Sequence[str], y: str, id_col: str, n: int, strata: DataFrame | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """The stratified, representative and density samples (and a multi-feature one when strata are given)."""
    from oddrows.operators.sampling import multi_feature_sample

    out = {
        "stratified": stratified_sample(df, id_col, y, n, seed),
        "kmeans": kmeans_representative_sample(df, cols, y, id_col, n, seed=seed),
        "density": density_sample(df, cols, y, id_col, n, seed=seed).drop("copy"),
    }
    if strata is not None:
        names = [c for c in strata.columns if c != id_col]
        picked = multi_feature_sample(strata, id_col, names, n, seed).select(id_col)
        out["multi_feature"] = df.join(picked, id_col, "left_semi")
    return out
