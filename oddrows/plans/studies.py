"""End-to-end studies: the prepared feature table, detectors, cluster labelling, parameter grids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddrows.functions.columns import COMMON_PROCESSES, DEFAULT_MOUNT_NAMESPACE, FIRST_REAL_USER, SYSTEM_IDS, distance_to
from oddrows.models import clustering as cl
from oddrows.models import linear as ln
from oddrows.models import nets, svm
from oddrows.models.common import summed
from oddrows.models.density import dbscan, dbscan_settings
from oddrows.models.isolation import isolation_forest
from oddrows.models.trees import balanced_weights, mdi_importance, tree_model
from oddrows.operators import features as ft
from oddrows.operators import joins as jn
from oddrows.operators import metrics as mt
from oddrows.operators import neighbors as nb
from oddrows.operators import stats as st
from oddrows.operators.profile import cluster_composition, mean_std_over_runs
from oddrows.operators.sampling import disjoint_split, sample_n
from oddrows.session import cut_lineage

# --- prepared features ---------------------------------------------------------------------------

FLAGS = ("bin_userId", "bin_processId", "bin_parentProcessId", "bin_mountNamespace", "is_common_process", "has_error", "user_system_process")


def log_flags(df: DataFrame) -> DataFrame:
    d = ft.flag_threshold(df, "userId", ">=", FIRST_REAL_USER, "bin_userId")
    d = ft.flag_in(d, "processId", SYSTEM_IDS, "bin_processId")
    d = ft.flag_in(d, "parentProcessId", SYSTEM_IDS, "bin_parentProcessId")
    d = ft.flag_equals(d, "mountNamespace", DEFAULT_MOUNT_NAMESPACE, "bin_mountNamespace")
    d = ft.flag_in(d, "processName", COMMON_PROCESSES, "is_common_process")
    return ft.flag_interaction(ft.flag_error(d))


def cluster_features(
    df: DataFrame, id_col: str, max_args: int | None = None, weight_split: str | None = "test", svd: int = 15, trees: int = 100, depth: int = 10
) -> tuple[DataFrame, dict[str, float]]:
    """The prepared clustering table: category axes, one-hot SVD, scaled numbers and flags, argument flags,
    split and labels; features above the median forest importance (fitted on ``weight_split``) are weighted up."""
    d = ft.flatten_args(ft.parse_args(log_flags(df)), max_args)
    values = [c for c in d.columns if c.startswith("args_value_")]
    d = ft.flag_pattern(d, values)  # on the raw text, before it becomes a number
    d = ft.args_to_numeric(d, values)
    d = ln.mca(d, ["eventId"], 5, "eventId_MCA_")
    d = ln.mca(d, ["processName"], 3, "processName_MCA_")
    d = ln.onehot_svd(d, ["eventName", "hostName"], svd)
    scaled = ["argsNum", "returnValue", *FLAGS, *values]
    d = ft.standardize(d, scaled, prefix="scaled_")
    d = ft.prefix_columns(d, [f"{v}_suspicious" for v in values], "binary_")
    features = [c for c in d.columns if "_MCA_" in c or c.startswith(("onehot_SVD_", "scaled_", "binary_"))]
    table = cut_lineage(d.select(id_col, *features, "split", "sus", "evil"))
    if weight_split is None:
        return table, {}
    fit = balanced_weights(table.filter(F.col("split") == weight_split), "evil", factor=0.0)
    model = tree_model(fit, features, "evil", trees=trees, depth=depth, weight="weight")
    importance = {r["feature"]: r["importance"] for r in mdi_importance(df.sparkSession, model).collect()}
    return ft.weight_features(table, importance), importance


# --- detectors -----------------------------------------------------------------------------------

DETECTORS = ("pca", "isolation", "svm", "autoencoder", "vae")


def detector_score(df: DataFrame, kind: str, cols: Sequence[str], id_col: str, fit_on: DataFrame, **kw) -> DataFrame:
    """Rows with an anomaly ``score`` from a model fitted on ``fit_on``."""
    if kind == "pca":
        return ln.pca_score(df, ln.pca_fit(fit_on, cols, kw.get("k", 3)), "score")
    if kind == "isolation":
        return isolation_forest(df, cols, id_col, fit_on=fit_on, **kw)
    if kind == "svm":
        return svm.one_class_svm(df, cols, id_col, fit_on=fit_on, **kw)
    if kind == "autoencoder":
        return nets.autoencoder_score(df, nets.autoencoder_fit(fit_on, cols, id_col, **kw), "score")
    if kind == "vae":
        return nets.vae_score(df, nets.vae_fit(fit_on, cols, id_col, **kw)).withColumn("score", F.col("total_loss"))
    raise ValueError(f"unknown detector {kind!r}, one of {DETECTORS}")


def detect(df: DataFrame, kind: str, cols: Sequence[str], id_col: str, y: str = "evil", **kw) -> tuple[DataFrame, DataFrame]:
    """Fit on benign rows, score all, choose the best-F1 threshold: scored rows with ``pred`` and a report."""
    scored = cut_lineage(detector_score(df, kind, cols, id_col, ft.train_filter_benign(df), **kw))
    areas = mt._areas(scored, "score", y, []).first()
    flagged = mt.apply_threshold(scored, "score", areas["best"]["score"])
    report = mt.binary_report(flagged, y, "pred").withColumns(
        {"detector": F.lit(kind), "roc_auc": F.lit(areas["roc_auc"]), "average_precision": F.lit(areas["average_precision"]), "threshold": F.lit(areas["best"]["score"])}
    )
    return flagged, report


# --- cluster, label, classify --------------------------------------------------------------------


def label_clusters(labelled: DataFrame, cluster: str = "cluster", y: str = "evil", thr: float = 0.2) -> DataFrame:
    """Verdict per cluster from its labelled members: 1 when their mean label is above ``thr``."""
    return labelled.groupBy(F.col(cluster).alias("cluster")).agg((F.avg(y) > thr).cast("int").alias("verdict"))


def _pcs(k: int) -> list[str]:
    return [f"pc_{i}" for i in range(k)]


def cluster_then_classify(
    df: DataFrame, cols: Sequence[str], id_col: str, sizes: dict[str, int], method: str = "dbscan", y: str = "evil", k: int = 8, eps: float = 0.5,
    min_samples: int = 5, dims: int | None = None, thr: float = 0.2, repeats: int = 1, seed: int = 42, vary: str = "test", predictor: str = "verdict",
) -> DataFrame:
    """Cluster one part, name clusters by a labelled part, classify a test part; mean and spread over repeats.

    ``sizes`` are the rows of the parts cluster, label, test. ``vary``: draw only the test part anew per
    repeat, or ``all``. ``predictor``: the cluster verdict, or ``distance`` (a cutoff sweep over the distance
    to the nearest centre).
    """
    rows = df.select(id_col, y, *cols)
    runs = None
    fitted = None
    for r in range(repeats):
        if fitted is None or vary == "all":
            base = seed + r if vary == "all" else seed
            parts = cut_lineage(disjoint_split(rows, id_col, {"cluster": sizes["cluster"], "label": sizes["label"]}, base))
            train, named = parts.filter("part = 'cluster'").drop("part"), parts.filter("part = 'label'").drop("part")
            xs = list(cols)
            axes = None
            if dims:
                axes, xs = ln.pca_fit(train, cols, dims), _pcs(dims)
                train, named = (ln.pca_transform(p, axes) for p in (train, named))
            fitted = _fit_assigner(train, xs, id_col, method, k, eps, min_samples, seed)
            verdicts = cut_lineage(label_clusters(fitted[0](named), y=y, thr=thr))
            rest = jn.exclude_rows(rows, parts, id_col)
        test = sample_n(rest, id_col, sizes["test"], seed + 2 + r)
        test = ln.pca_transform(test, axes) if axes is not None else test
        if predictor == "distance":
            placed = cl.nearest_center(test, xs, fitted[1])
            run = mt.cutoff_sweep(cut_lineage(placed), "distance", y, id_col)
        else:
            run = mt.posneg_metrics(jn.broadcast_verdict(fitted[0](test), verdicts, verdict="pred"), y, "pred")
        run = run.withColumn("run", F.lit(r))
        runs = run if runs is None else runs.unionByName(run)
    names = ["precision_pos", "recall_pos", "f1_pos", "precision_neg", "recall_neg", "f1_neg", "mutual_info"]
    return mean_std_over_runs(runs, ["cutoff"] if predictor == "distance" else [], names)


def _fit_assigner(train, xs, id_col, method, k, eps, min_samples, seed) -> tuple[Callable[[DataFrame], DataFrame], np.ndarray]:
    """(rows -> rows with ``cluster``, centres of the clusters)."""
    if method == "kmeans":
        model = cl.kmeans_fit(train, xs, k, id_col, seed)
        return (lambda d: cl.nearest_center(d, xs, model.centers)), model.centers
    if method == "dbscan":
        labelled = cut_lineage(dbscan(train, xs, id_col, eps, min_samples))
        return (lambda d: nb.nearest_neighbor_assign(d, labelled, xs, id_col, "cluster")), cluster_means(labelled, xs)
    raise ValueError(f"unknown method {method!r}")


def cluster_means(df: DataFrame, xs: Sequence[str], cluster: str = "cluster") -> np.ndarray:
    """Member means of the clusters other than noise, by cluster number."""
    rows = df.filter(F.col(cluster) != -1).groupBy(cluster).agg(*[F.avg(x).alias(x) for x in xs]).orderBy(cluster).collect()
    return np.array([[r[x] for x in xs] for r in rows]).reshape(len(rows), len(xs))


# --- grids ---------------------------------------------------------------------------------------

MOMENT_ROWS = 50_000  # clusters whose moments are sent to the tasks at once; a single clustering may have more


def eps_for(k: int) -> float:
    return 0.1 + 0.1 * (k - 2)


def cluster_labels(df: DataFrame, xs: Sequence[str], id_col: str, alg: str, k: int, seed: int = 42, min_samples: int = 5, eps: float | None = None):
    """Rows with ``cluster`` under one of the five algorithms, and the inertia (k-means only)."""
    if alg == "kmeans":
        rows, model = cl.kmeans(df, xs, k, id_col, seed)
        return rows, model.cost
    if alg == "hierarchical":
        return cl.hierarchical(df, xs, k, id_col)[0], None
    if alg == "dbscan":
        return dbscan(df, xs, id_col, eps if eps is not None else eps_for(k), min_samples), None
    if alg == "gmm":
        return cl.gmm(df, xs, k, id_col, seed), None
    if alg == "fcm":
        return cl.fuzzy_cmeans(df, xs, k, id_col, seed=seed)[0], None
    raise ValueError(f"unknown algorithm {alg!r}")


QUALITY = ("n_clusters_found", "noise", "n", "silhouette", "mi", "precision", "recall", "f1")


def quality_of_labels(labelled: DataFrame, names: Sequence[str], thr: float = 0.2) -> DataFrame:
    """``QUALITY`` of several clusterings of the same weighted points, one row per clustering ``cell``.

    ``labelled`` has x, w (rows of the point), w1 (those of class 1) and the label columns (-1 is noise, null counts as noise). One scan sums
    the moments of all clusters, a second one the silhouettes, in squared distances taken from the moments. Verdicts of
    clusters and their precision, recall, F1 and mutual information follow from the sums.
    """
    d = labelled.select(F.max(F.size("x"))).first()[0] or 0
    cells = F.array(*[F.struct(F.lit(n).alias("cell"), F.coalesce(F.col(n).cast("long"), F.lit(-1)).alias("c")) for n in names])
    long = labelled.select("x", "w", "w1", F.explode(cells).alias("_l")).select("x", "w", "w1", "_l.cell", "_l.c")
    at = [F.get("x", F.lit(j)) for j in range(d)]
    sums = [F.sum(F.col("w") * a).alias(f"s{j}") for j, a in enumerate(at)]
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    moments = cut_lineage(long.groupBy("cell", "c").agg(F.sum("w").alias("w"), F.sum("w1").alias("w1"), F.sum(F.col("w") * square).alias("q"), *sums))
    widths = _silhouettes(labelled, moments, names, d)
    whole = moments.groupBy("cell").agg(F.sum("w").alias("n"), F.sum("w1").alias("n1"))
    tagged = moments.select("cell", "c", "w", "w1", ((F.col("c") != -1) & (F.col("w1") / F.col("w") > thr)).cast("int").alias("v")).join(whole, "cell")
    parts = [F.struct(F.col("w1").alias("k"), F.col("n1").alias("m")), F.struct((F.col("w") - F.col("w1")).alias("k"), (F.col("n") - F.col("n1")).alias("m"))]
    mi = F.aggregate(F.array(*parts), F.lit(0.0), lambda t, p: t + F.when(p["k"] > 0, p["k"] / F.col("n") * F.ln(p["k"] * F.col("n") / (p["m"] * F.col("w")))).otherwise(0.0))
    out = tagged.withColumn("mi", mi).groupBy("cell").agg(
        F.count_if(F.col("c") != -1).cast("double").alias("n_clusters_found"),
        F.coalesce(F.sum(F.when(F.col("c") == -1, F.col("w"))), F.lit(0)).cast("double").alias("noise"),
        F.max("n").cast("double").alias("n"),
        F.greatest(F.sum("mi"), F.lit(0.0)).alias("mi"),
        F.sum(F.col("v") * F.col("w1")).alias("tp"),
        F.sum(F.col("v") * F.col("w")).alias("pp"),
        F.max("n1").alias("n1"),
    )
    out = out.withColumns({"precision": mt.ratio(F.col("tp"), F.col("pp")), "recall": mt.ratio(F.col("tp"), F.col("n1")), "f1": mt.ratio(2 * F.col("tp"), F.col("pp") + F.col("n1"))})
    return out.join(widths, "cell").select("cell", *QUALITY)


def _silhouettes(labelled: DataFrame, moments: DataFrame, names: Sequence[str], d: int) -> DataFrame:
    """Mean moment silhouette of every clustering; -1 with fewer than two clusters."""
    spark = labelled.sparkSession
    many = {r["cell"]: r["count"] for r in moments.filter("c <> -1").groupBy("cell").count().collect()}
    value = {n: -1.0 for n in names}
    # as many clusterings at once as the moments of their clusters stay small
    groups: list[list[str]] = []
    held = 0
    for n in names:
        if many.get(n, 0) < 2:
            continue
        if not groups or held + many[n] > MOMENT_ROWS:
            groups.append([])
            held = 0
        groups[-1].append(n)
        held += many[n]
    for group in groups:
        table = moments.filter(F.col("cell").isin(group) & (F.col("c") != -1)).orderBy("cell", "c").toPandas()
        known = {}
        for n in group:
            part = table[table["cell"] == n]
            w = part["w"].to_numpy(dtype=float)
            mean = part[[f"s{j}" for j in range(d)]].to_numpy(dtype=float) / w[:, None]
            known[n] = (part["c"].to_numpy(), w, mean, np.maximum(0.0, part["q"].to_numpy(dtype=float) - w * (mean**2).sum(axis=1)))
        shared = spark.sparkContext.broadcast(known)

        def sums(b, group=group, shared=shared):
            x, weight = nb.coordinates(b), b["w"].to_numpy(dtype=float)
            out = np.zeros(2 * len(group))
            for k, n in enumerate(group):
                c, w, mean, inside = shared.value[n]
                label = b[n].fillna(-1).to_numpy(dtype=np.int64)
                step = max(1, 2_000_000 // len(c))
                rows = np.flatnonzero(label != -1)
                for i in range(0, len(rows), step):
                    at = rows[i : i + step]
                    own = np.searchsorted(c, label[at])
                    total = nb.sq_distances(x[at], mean) * w[None, :] + inside[None, :]
                    mine = total[np.arange(len(at)), own] / np.maximum(1.0, w[own] - 1)
                    other = total / w[None, :]
                    other[np.arange(len(at)), own] = np.inf
                    other = other.min(axis=1)
                    top = np.maximum(mine, other)
                    s = np.where((w[own] <= 1) | (top == 0), 0.0, (other - mine) / np.where(top == 0, 1.0, top))
                    out[2 * k] += (weight[at] * s).sum()
                    out[2 * k + 1] += weight[at].sum()
            return out

        found = summed(labelled.select("x", "w", *group), sums, 2 * len(group))
        value |= {n: float(found[2 * k] / found[2 * k + 1]) for k, n in enumerate(group)}
    return spark.createDataFrame(list(value.items()), "cell string, silhouette double")


def cluster_quality(rows: DataFrame, xs: Sequence[str], id_col: str, y: str, thr: float = 0.2, exact: bool = False) -> dict:
    """``QUALITY`` of one clustering of rows; ``exact`` takes the silhouette from all distances instead of cluster moments."""
    points = rows.groupBy(nb.point(xs).alias("x"), F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("w"), F.sum(y).alias("w1"))
    found = quality_of_labels(cut_lineage(points), ["cluster"], thr).first().asDict()
    if exact:
        found["silhouette"] = nb.silhouette(rows, xs, id_col, "cluster").first()["silhouette"]
    return {m: found[m] for m in QUALITY}


def _run_cells(spark: SparkSession, cells: Sequence, run: Callable, threads: int) -> list:
    """Independent Spark jobs from a few driver threads; the cluster shares them out."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(run, cells))


def weighted_points(df: DataFrame, xs: Sequence[str], id_col: str, y: str) -> DataFrame:
    """Distinct points: x, pid, rows ``w``, rows of class 1 ``w1``."""
    rows = df.filter(nb.complete(xs)).select(nb.point(xs).alias("x"), F.col(id_col).cast("long").alias("id"), F.col(y).cast("long").alias("y"))
    return cut_lineage(rows.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("w"), F.sum("y").alias("w1")))


def labels_for_all(points: DataFrame, xs: Sequence[str], alg: str, ks: Sequence[int], seed: int = 42, min_samples: int = 5) -> tuple[DataFrame, list[int], dict[int, float]]:
    """Labels of the points under one algorithm for every k (columns ``k<k>`` beside pid), the k that could be had, k-means costs.

    k-means and fuzzy c-means fit all k in the same scans, Ward cuts one tree; mixtures and DBSCAN (whose reach follows k) are
    fitted one by one.
    """
    spark = points.sparkSession
    few = points.count()
    ks = [k for k in ks if alg in ("kmeans", "dbscan") or k <= few]
    if alg in ("kmeans", "fcm"):
        models = cl.kmeans_models(points, xs, ks, seed) if alg == "kmeans" else cl.fuzzy_models(points, xs, ks, seed=seed) if ks else {}
        ks = [k for k in ks if k in models]
        shared = spark.sparkContext.broadcast([models[k].centers for k in ks])

        def label(batches):
            indexes = [cl.CenterIndex(c) for c in shared.value]
            for b in batches:
                x = nb.coordinates(b)
                yield pd.DataFrame({"pid": b["pid"], **{f"k{k}": index.nearest(x)[0].astype("int64") for k, index in zip(ks, indexes)}})

        out = points.mapInPandas(label, "pid long" + "".join(f", k{k} long" for k in ks))
        return out, ks, {k: models[k].cost for k in ks} if alg == "kmeans" else {}
    if alg == "hierarchical":
        if not ks:
            return points.select("pid"), ks, {}
        roots = cl.ward_tree(points).labels(ks)
        return roots.select("pid", *[F.col(f"root_{k}").alias(f"k{k}") for k in ks]), ks, {}
    if alg == "dbscan":
        labels = dbscan_settings(points, [(eps_for(k), min_samples) for k in ks])
        return labels.select("pid", *[F.col(f"c{i}").alias(f"k{k}") for i, k in enumerate(ks)]), ks, {}
    if alg != "gmm":
        raise ValueError(f"unknown algorithm {alg!r}")
    named = points.select("pid", "w", *[F.get("x", F.lit(i)).alias(x) for i, x in enumerate(xs)])
    out = points.select("pid")
    for k in ks:
        one = cl.gmm_score(named, cl.gmm_of_points(points, xs, k, seed)).select("pid", F.col("cluster").cast("long").alias(f"k{k}"))
        out = out.join(cut_lineage(one), "pid", "left")
    return out, ks, {}


def internal_grid(
    df: DataFrame, cols: Sequence[str], id_col: str, y: str, dims: Sequence[int], ks: Sequence[int], algs: Sequence[str], trials: int = 1,
    sample_size: int | None = None, seed: int = 42, threads: int = 4, exact: bool = False,
) -> DataFrame:
    """Every algorithm x components x clusters x trial, one row each; a cell that cannot be had scores -1.

    All k of an algorithm share their scans. ``exact`` takes silhouettes from all distances (quadratic) instead of cluster moments.
    """
    spark = df.sparkSession
    frames = {}
    for t in range(trials):
        rows = df.select(id_col, y, *cols)
        part = sample_n(rows, id_col, sample_size, seed + t) if sample_size else rows
        part = cut_lineage(part)
        for d in dims:
            model = ln.pca_fit(part, cols, d)
            frames[t, d] = (weighted_points(ln.pca_transform(part, model), _pcs(d), id_col, y), float(model.ratio.sum()))

    def one(cell):
        t, d, alg = cell
        points, explained = frames[t, d]
        labels, had, costs = labels_for_all(points, _pcs(d), alg, ks, seed + t)
        names = [f"k{k}" for k in had]
        labelled = cut_lineage(points.join(labels, "pid", "left"))
        found = {r["cell"]: r.asDict() for r in quality_of_labels(labelled, names).collect()} if had else {}
        rows = []
        for k in ks:
            if f"k{k}" not in found:
                rows.append((alg, d, k, t, explained, None, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0))
                continue
            q = found[f"k{k}"]
            if exact:
                each = labelled.select("pid", F.explode(F.array_repeat("x", F.col("w").cast("int"))).alias("x"), F.coalesce(f"k{k}", F.lit(-1)).alias("cluster"))
                named = each.select(F.monotonically_increasing_id().alias("row"), "cluster", *[F.get("x", F.lit(i)).alias(x) for i, x in enumerate(_pcs(d))])
                q["silhouette"] = nb.silhouette(cut_lineage(named), _pcs(d), "row", "cluster").first()["silhouette"]
            rows.append((alg, d, k, t, explained, costs.get(k), *[q[m] for m in QUALITY]))
        return rows

    cells = [(t, d, a) for t in range(trials) for d in dims for a in algs]
    schema = "algorithm string, pca_dim int, n_clusters int, trial int, variance_explained double, inertia double, " + ", ".join(
        f"{m} double" for m in QUALITY
    )
    out = spark.createDataFrame([r for rows in _run_cells(spark, cells, one, threads) for r in rows], schema)
    return out.withColumn("combined_score", F.col("silhouette") + F.col("mi"))


def grid_means(grid: DataFrame) -> DataFrame:
    return mean_std_over_runs(
        grid, ["algorithm", "pca_dim", "n_clusters"], ["n_clusters_found", "variance_explained", "silhouette", "mi", "precision", "recall", "f1", "combined_score", "inertia"]
    )


def best_params(grid: DataFrame) -> DataFrame:
    """Best silhouette per algorithm ``(algorithm, n_clusters, pca_dim, silhouette, eps)``; smallest dim, then k on ties."""
    cells = grid.groupBy("algorithm", "pca_dim", "n_clusters").agg(F.avg("silhouette").alias("silhouette"))
    best = F.max_by(F.struct("n_clusters", "pca_dim", "silhouette"), F.struct("silhouette", -F.col("pca_dim"), -F.col("n_clusters")))
    out = cells.groupBy("algorithm").agg(best.alias("b")).select("algorithm", "b.*")
    return out.withColumn("eps", F.lit(0.1) + F.lit(0.1) * (F.col("n_clusters") - 2))


def best_inertia_dim(grid: DataFrame) -> DataFrame:
    """Components with the lowest total k-means inertia over all k."""
    cells = grid.filter("inertia is not null").groupBy("pca_dim", "n_clusters").agg(F.avg("inertia").alias("i"))
    total = cells.groupBy("pca_dim").agg(F.sum("i").alias("inertia"))
    best = F.min_by(F.struct("pca_dim", "inertia"), F.struct("inertia", "pca_dim"))
    return total.agg(best.alias("b")).select("b.*")


def elbow(curve: DataFrame, x: str, y: str, sensitivity: float = 1.0) -> DataFrame:
    """Knee of a convex decreasing curve (Kneedle, Satopaa et al. 2011); steepest gradient when there is none.

    The curve has one row per k, so the ordered windows are tiny.
    """
    everyone = Window.partitionBy(F.lit(1))
    w = everyone.orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pts = curve.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lo_x, hi_x, lo_y, hi_y = (f(c).over(everyone) for c in ("x", "y") for f in (F.min, F.max))
    xn = (F.col("x") - lo_x) / (hi_x - lo_x)
    yn = 1 - (F.col("y") - lo_y) / (hi_y - lo_y)
    d = pts.withColumns({"xn": xn, "d": yn - xn, "i": F.row_number().over(w), "n": F.count("*").over(everyone)})
    before, after = F.coalesce(F.lag("d").over(w), F.col("d")), F.coalesce(F.lead("d").over(w), F.col("d"))
    d = d.withColumns({"up": (F.col("d") >= before) & (F.col("d") >= after), "down": (F.col("d") <= before) & (F.col("d") <= after)})
    step = sensitivity / (F.col("n") - 1)  # mean step of the normalized x
    d = d.withColumns(
        {
            "top": F.max(F.when(F.col("up"), F.struct("i", "x", (F.col("d") - step).alias("t")))).over(upto),
            "low": F.max(F.when(F.col("down"), F.col("i"))).over(upto),
            "next": F.lead("d").over(w),
            "slope": F.when(F.lag("y").over(w).isNull(), (F.lead("y").over(w) - F.col("y")) / (F.lead("x").over(w) - F.col("x")))
            .when(F.lead("y").over(w).isNull(), (F.col("y") - F.lag("y").over(w)) / (F.col("x") - F.lag("x").over(w)))
            .otherwise((F.lead("y").over(w) - F.lag("y").over(w)) / (F.lead("x").over(w) - F.lag("x").over(w))),
        }
    )
    limit = F.when(F.coalesce(F.col("low"), F.lit(0)) >= F.col("top.i"), F.lit(0.0)).otherwise(F.col("top.t"))
    fired = F.col("top").isNotNull() & F.col("next").isNotNull() & (F.col("next") < limit)
    return d.agg(
        F.coalesce(F.min_by("top.x", F.when(fired, F.col("i"))), F.min_by("x", F.struct("slope", "x"))).alias("elbow"),
        (F.count_if(fired) > 0).cast("int").alias("is_knee"),
    )


def external_eval(
    df: DataFrame, cols: Sequence[str], id_col: str, y: str, method: str, k: int, dims: int, runs: int = 1, sample_size: int | None = None,
    fracs: Sequence[float] = mt.FRACTIONS, seed: int = 0, switch_at: int | None = None,
) -> DataFrame:
    """Cutoff metrics averaged over seeds: distance to the nearest centre (k-means, Ward, DBSCAN), low
    likelihood (gmm) or low membership (fcm). With ``switch_at``, other methods than k-means use DBSCAN from
    that k on."""
    if switch_at is not None and method != "kmeans" and k >= switch_at:
        method = "dbscan"
    out = None
    for r in range(runs):
        rows = df.select(id_col, y, *cols)
        part = cut_lineage(sample_n(rows, id_col, sample_size, seed + r) if sample_size else rows)
        xs = _pcs(dims)
        p = cut_lineage(ln.pca_transform(part, ln.pca_fit(part, cols, dims)).select(id_col, y, *xs))
        if method == "gmm":
            sweep = mt.quantile_sweep(cut_lineage(cl.gmm(p, xs, k, id_col, seed + r)), "log_likelihood", y, fracs)
        elif method == "fcm":
            sweep = mt.membership_sweep(cl.fuzzy_cmeans(p, xs, k, id_col, seed=seed + r)[0], "max_membership", y, fracs)
        else:
            labelled, _ = cluster_labels(p, xs, id_col, method, k, seed + r)
            centers = cluster_means(cut_lineage(labelled), xs)
            if not len(centers):
                continue  # all noise
            sweep = mt.cutoff_sweep(cut_lineage(cl.nearest_center(p, xs, centers)), "distance", y, id_col, fracs)
        sweep = sweep.withColumn("run", F.lit(r))
        out = sweep if out is None else out.unionByName(sweep)
    names = ["precision_pos", "recall_pos", "f1_pos", "precision_neg", "recall_neg", "f1_neg", "mutual_info"]
    if out is None:
        schema = "cutoff double, " + ", ".join(f"{m}_mean double, {m}_std double" for m in names)
        return df.sparkSession.createDataFrame([], schema)
    return mean_std_over_runs(out, ["cutoff"], names)


def dbscan_grid(
    df: DataFrame, cols: Sequence[str], id_col: str, y: str, dims: Sequence[int], epss: Sequence[float], mins: Sequence[int], threads: int = 4
) -> DataFrame:
    """DBSCAN over components x eps x min_samples: clusters, silhouette, MI, P/R/F1, noise share."""
    spark = df.sparkSession
    rows = cut_lineage(df.select(id_col, y, *cols))
    frames = {d: weighted_points(ln.pca_transform(rows, ln.pca_fit(rows, cols, d)), _pcs(d), id_col, y) for d in dims}

    settings = [(float(e), m) for e in epss for m in mins]

    def one(d):
        labels = dbscan_settings(frames[d], settings)
        labelled = cut_lineage(frames[d].join(labels, "pid", "left"))
        found = {r["cell"]: r for r in quality_of_labels(labelled, [f"c{i}" for i in range(len(settings))]).collect()}
        return [(d, *s, *[found[f"c{i}"][q] for q in QUALITY]) for i, s in enumerate(settings)]

    # all settings of the same points are judged together
    data = [row for rows in _run_cells(spark, dims, one, threads) for row in rows]
    schema = "pca_dim int, eps double, min_samples int, " + ", ".join(f"{c} double" for c in QUALITY)
    out = spark.createDataFrame(data, schema)
    return out.withColumns({"combined_score": F.col("silhouette") + F.col("mi"), "noise_percentage": F.col("noise") * 100.0 / F.col("n")})


def best_of_grid(grid: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("silhouette", "mi", "f1", "combined_score")) -> DataFrame:
    """The best setting by each metric, smallest keys on ties."""
    long = grid.unpivot(list(keys), list(metrics), "metric", "value")
    first = F.struct("value", *[(-F.col(k)).alias(f"n{i}") for i, k in enumerate(keys)])
    return long.groupBy("metric").agg(F.max_by(F.struct(*keys, "value"), first).alias("b")).select("metric", "b.*")


# --- one cluster ---------------------------------------------------------------------------------


def investigate_cluster(df: DataFrame, xs: Sequence[str], cluster_id: int, cluster: str = "cluster", y: str = "evil", k: int = 5, top: int = 10) -> DataFrame:
    """Size, evil share, most shifted features and nearest other centres as ``(section, name, value)`` rows."""
    size = cluster_composition(df.filter(F.col(cluster) == cluster_id), cluster, y).select(
        F.inline(
            F.array(
                F.struct(F.lit("size").alias("name"), F.col("n").cast("double").alias("value")),
                F.struct(F.lit("evil").alias("name"), F.col("evil_n").cast("double").alias("value")),
                F.struct(F.lit("evil_percent").alias("name"), F.col("evil_percent").alias("value")),
            )
        )
    )
    shift = st.cluster_feature_shift(df.withColumn("_in", (F.col(cluster) == cluster_id).cast("int")), "_in", xs).limit(top)
    means = df.filter(F.col(cluster) != -1).groupBy(cluster).agg(*[F.avg(x).alias(x) for x in xs])
    own = means.filter(F.col(cluster) == cluster_id).first()
    out = size.select(F.lit("size").alias("section"), "name", "value")
    out = out.unionByName(shift.select(F.lit("shift").alias("section"), F.col("feature").alias("name"), F.col("importance").alias("value")))
    if own is None:  # noise has no centre
        return out
    near = means.filter(F.col(cluster) != cluster_id).select(F.col(cluster).alias("b"), distance_to(xs, [own[x] for x in xs]).alias("distance"))
    near = near.orderBy("distance", "b").limit(k)
    return out.unionByName(near.select(F.lit("center distance").alias("section"), F.col("b").cast("string").alias("name"), F.col("distance").alias("value")))


def evil_cluster_tests(df: DataFrame, xs: Sequence[str], verdicts: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Feature tests of every cluster with verdict 1 (noise aside)."""
    evil = [r["cluster"] for r in verdicts.filter("verdict = 1 AND cluster <> -1").orderBy("cluster").collect()]
    return st.cluster_feature_tests(df, cluster, xs, evil)


def project_2d(df: DataFrame, cols: Sequence[str], n: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Principal-component coordinates of every row on 2 or 3 axes, with the columns to colour by."""
    return ln.pca_transform(df, ln.pca_fit(df, cols, n)).select(*keep, *_pcs(n))
