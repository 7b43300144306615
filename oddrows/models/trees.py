"""Decision trees and forests: fitting, importance, rules, thresholds, usage, Shapley values.

Fitting is Spark's own; the node table is read back from the saved model, and everything about rows
(leaf sizes, class mixes, split sides) comes from one grouping of the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddrows.functions.columns import leading, seeded_key
from oddrows.models.common import assembled, training_rows
from oddrows.operators import metrics as mt
from oddrows.operators.features import standardize
from oddrows.operators.order import row_index
from oddrows.operators.sampling import capped_stratified, train_test
from oddrows.session import cut_lineage, scratch_path

TABLE_FEATURES = 8  # features on a path up to which a leaf's Shapley values are looked up
TABLE_CELLS = 1 << 18  # numbers of a table, and places looked up at once
TASK_WORK = 200_000_000  # points x leaves of a task


@dataclass
class Trees:
    cols: list[str]
    label: str
    model: Any
    kind: str


def balanced_weights(df: DataFrame, y: str, out: str = "weight", factor: float = 10.0) -> DataFrame:
    """n / (classes * class rows), or 1 when the classes differ by no more than ``factor``."""
    counts = {r[y]: r["count"] for r in df.groupBy(y).count().collect()}
    n, k = sum(counts.values()), len(counts)
    if k and max(counts.values()) / min(counts.values()) > factor:
        expr = F.lit(1.0)
        for v, c in counts.items():
            expr = F.when(F.col(y).eqNullSafe(F.lit(v)), F.lit(n / (k * c))).otherwise(expr)
        return df.withColumn(out, expr)
    return df.withColumn(out, F.lit(1.0))


def tree_model(
    df: DataFrame, cols: Sequence[str], y: str, kind: str = "forest", depth: int | None = None, trees: int = 100, seed: int = 42, weight: str | None = None
) -> Trees:
    """Decision tree (depth 5) or random forest (100 trees, depth 10)."""
    vec = assembled(df, cols).withColumn("_y", F.col(y).cast("double"))
    common = {"featuresCol": "features", "labelCol": "_y", "seed": seed, "leafCol": "leaf", "maxBins": 64}
    if weight:
        common["weightCol"] = weight
    if kind == "tree":
        est = DecisionTreeClassifier(maxDepth=depth or 5, **common)
    else:
        est = RandomForestClassifier(maxDepth=depth or 10, numTrees=trees, **common)
    kept = ["features", "_y", *([weight] if weight else [])]
    return Trees(list(cols), y, est.fit(training_rows(vec.select(*kept))), kind)


def predict(df: DataFrame, t: Trees, score: str = "score", pred: str = "pred") -> DataFrame:
    """Probability of class 1 and predicted class."""
    out = t.model.transform(assembled(df, t.cols))
    return out.withColumns({score: F.get(vector_to_array("probability"), F.lit(1)), pred: F.col("prediction").cast("int")}).drop(
        "features", "rawPrediction", "probability", "prediction", "leaf"
    )


# --- importance ----------------------------------------------------------------------------------


def mdi_importance(spark: SparkSession, t: Trees) -> DataFrame:
    """Impurity importance per feature, highest first."""
    values = t.model.featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(t.cols, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def select_above_median(importance: DataFrame) -> DataFrame:
    """Features above the median importance (one row per feature)."""
    w = Window.partitionBy(F.lit(1))
    return importance.withColumn("_m", F.percentile("importance", 0.5).over(w)).filter(F.col("importance") > F.col("_m")).drop("_m")


def permutation_importance(df: DataFrame, t: Trees, id_col: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Drop in accuracy when one column is shuffled: mean and population deviation over repeats.

    Rows get a seeded random position once; repeat r pairs position i with (a_r * i + b_r) mod n, a
    permutation of that order, by an equi-join on the position. All columns of a repeat share the join.
    """
    base = df.select(id_col, F.col(t.label).cast("double").alias("_y"), F.array(*[F.col(c).cast("double") for c in t.cols]).alias("_x"))
    placed = cut_lineage(row_index(base.withColumn("_k", seeded_key(seed, id_col)), "_k", id_col, out="_i").drop("_k"))
    n = placed.count()
    rng = random.Random(seed)
    moves = []
    for r in range(repeats):
        a = next((x for x in iter(lambda: rng.randrange(1, min(n, 1_000_000) + 1), None) if math.gcd(x, n) == 1), 1)
        moves.append(F.struct(F.lit(r).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(rng.randrange(n)).cast("long").alias("b")))
    asked = placed.select("_i", "_y", "_x", F.inline(F.array(*moves)))
    donors = placed.select(F.col("_i").alias("_d"), F.col("_x").alias("_z"))
    # all rows stand on both sides; the size that Spark assumes of them, that of compressed files, would let it broadcast them
    paired = asked.withColumn("_d", F.pmod(F.col("a") * F.col("_i") + F.col("b"), F.lit(n))).join(donors.hint("merge"), "_d")
    swaps = [
        F.struct(F.lit(j).alias("j"), F.array(*[F.get("_z" if i == j else "_x", F.lit(i)) for i in range(len(t.cols))]).alias("v"))
        for j in range(len(t.cols))
    ]
    probes = paired.select("r", "_y", F.inline(F.array(*swaps))).withColumn("features", array_to_vector("v"))
    hit = (F.col("prediction") == F.col("_y")).cast("double")
    per = t.model.transform(probes).groupBy("j", "r").agg(F.avg(hit).alias("acc"))
    whole = t.model.transform(placed.withColumn("features", array_to_vector("_x"))).agg(F.avg(hit)).first()[0]
    names = F.array(*[F.lit(c) for c in t.cols])
    return per.groupBy(F.get(names, F.col("j")).alias("feature")).agg(
        F.avg(F.lit(whole) - F.col("acc")).alias("importance"), F.stddev_pop(F.lit(whole) - F.col("acc")).alias("std")
    )


# --- node table ----------------------------------------------------------------------------------


def node_frame(spark: SparkSession, t: Trees) -> DataFrame:
    """``(tree, node, feature, threshold, left, right, prediction, impurity, mix, rows, is_leaf)``."""
    path = scratch_path(spark, "trees")
    t.model.write().save(path)
    raw = spark.read.parquet(f"{path}/data")
    if "nodeData" in raw.columns:
        raw = raw.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        raw = raw.withColumn("tree", F.lit(0))
    names = F.array(*[F.lit(c) for c in t.cols])
    leaf = F.col("leftChild") < 0
    return raw.select(
        "tree",
        F.col("id").alias("node"),
        F.when(~leaf, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        "prediction",
        "impurity",
        F.col("impurityStats").alias("mix"),
        F.col("rawCount").alias("rows"),
        leaf.alias("is_leaf"),
    )


def _trees(spark: SparkSession, t: Trees) -> dict[int, dict[int, Any]]:
    """Nodes by tree; at most trees x 2^(depth + 1) rows."""
    out: dict[int, dict[int, Any]] = {}
    for r in node_frame(spark, t).collect():
        out.setdefault(r["tree"], {})[r["node"]] = r
    return out


def _paths(nodes: dict[int, Any]):
    """Leaves from left to right (the order of Spark's leaf index) with the steps that lead there."""
    out = []
    stack = [(0, [])]
    while stack:
        i, steps = stack.pop()
        n = nodes[i]
        if n["is_leaf"]:
            out.append((i, steps))
        else:
            stack.append((n["right"], [*steps, (n, False)]))
            stack.append((n["left"], [*steps, (n, True)]))
    return out


def leaf_rows(df: DataFrame, t: Trees) -> DataFrame:
    """Rows and class mix per (tree, leaf), counted from the data: ``(tree, leaf, n, positives)``."""
    scored = t.model.transform(assembled(df, t.cols))
    leaves = F.array(F.col("leaf").cast("int")) if t.kind == "tree" else F.transform(vector_to_array("leaf"), lambda v: v.cast("int"))
    long = scored.select(F.col(t.label).cast("int").alias("_y"), F.posexplode(leaves).alias("tree", "leaf"))
    return long.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("positives"))


def tree_rules(df: DataFrame, t: Trees) -> DataFrame:
    """Every leaf of a decision tree as a rule: path, majority class, class mix and rows."""
    spark = df.sparkSession
    rows = []
    for leaf, (_, steps) in enumerate(_paths(_trees(spark, t)[0])):
        text = " AND ".join(f"{n['feature']} {'<=' if left else '>'} {n['threshold']:.6g}" for n, left in steps)
        rows.append((leaf, len(steps), text or "TRUE"))
    rules = spark.createDataFrame(rows, "leaf int, depth int, rule string")
    stats = leaf_rows(df, t).drop("tree")
    return (
        rules.join(stats, "leaf", "left")  # a leaf that no row of ``df`` reaches has zero rows and no share
        .fillna(0, ["n", "positives"])
        .withColumn("positive_share", F.when(F.col("n") > 0, F.col("positives") / F.col("n")))
        .withColumn("majority", (F.col("positive_share") > 0.5).cast("int"))
    )


def tree_thresholds(df: DataFrame, t: Trees) -> DataFrame:
    """Distinct split thresholds per feature with how often they occur, and the rows and positives on each side.

    All splits are counted by one grouping of the rows by their cell between neighbouring thresholds.
    """
    spark = df.sparkSession
    nodes = node_frame(spark, t).filter("not is_leaf")
    uses = nodes.groupBy("feature", "threshold").agg(F.count("*").alias("uses"))
    per = uses.groupBy("feature").agg(F.sort_array(F.collect_list("threshold")).alias("cuts"))  # a few per feature
    long = df.select(F.col(t.label).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in t.cols]).unpivot(
        ["_y"], t.cols, "feature", "value"
    )
    placed = long.join(F.broadcast(per), "feature")
    cell = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    counts = placed.groupBy("feature", cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("_y") == 1).alias("p"))
    cuts = per.select("feature", F.posexplode("cuts").alias("i", "threshold"), F.size("cuts").alias("k"))
    sides = cuts.join(counts, "feature").groupBy("feature", "threshold", "k").agg(
        F.sum(F.when(F.col("cell") <= F.col("i"), F.col("n")).otherwise(0)).alias("n_left"),
        F.sum(F.when(F.col("cell") <= F.col("i"), F.col("p")).otherwise(0)).alias("positives_left"),
        F.sum(F.when(F.col("cell") > F.col("i"), F.col("n")).otherwise(0)).alias("n_right"),
        F.sum(F.when(F.col("cell") > F.col("i"), F.col("p")).otherwise(0)).alias("positives_right"),
    )
    return sides.join(uses, ["feature", "threshold"]).withColumn("binary_split", F.col("k") == 1).drop("k")


def forest_usage(spark: SparkSession, t: Trees) -> DataFrame:
    """Depth and feature use of a forest as ``(kind, a, b, value)`` rows: depth min / mean / max, features per
    tree, splits per feature, and the share of trees that use two features together."""
    nodes = cut_lineage(node_frame(spark, t))
    depths = [(tree, max(len(s) for _, s in _paths(ns))) for tree, ns in _trees(spark, t).items()]
    depth = spark.createDataFrame(depths, "tree int, depth int").agg(
        F.min("depth").cast("double").alias("min"), F.avg("depth").alias("mean"), F.max("depth").cast("double").alias("max")
    )
    n_trees = len(depths)
    used = nodes.filter("not is_leaf").select("tree", "feature").distinct()
    per_tree = used.groupBy("tree").agg(F.count("*").alias("n")).agg(F.avg("n").alias("value"))
    splits = nodes.filter("not is_leaf").groupBy("feature").agg(F.count("*").cast("double").alias("value"))
    a, b = used.select("tree", F.col("feature").alias("a")), used.select("tree", F.col("feature").alias("b"))
    together = a.join(b, "tree").filter("a < b").groupBy("a", "b").agg((F.count("*") / n_trees).alias("value"))
    none = F.lit(None).cast("string")
    out = depth.unpivot([], ["min", "mean", "max"], "a", "value").select(F.lit("depth").alias("kind"), "a", none.alias("b"), "value")
    out = out.unionByName(per_tree.select(F.lit("features per tree").alias("kind"), none.alias("a"), none.alias("b"), "value"))
    out = out.unionByName(splits.select(F.lit("splits").alias("kind"), F.col("feature").alias("a"), none.alias("b"), "value"))
    return out.unionByName(together.select(F.lit("together").alias("kind"), "a", "b", "value"))


# --- Shapley values ------------------------------------------------------------------------------


def _leaf_games(spark: SparkSession, t: Trees):
    """Per leaf: class-1 share / trees, and per feature on its path (index, low, high, cover ratio)."""
    games, base = [], 0.0
    forest = _trees(spark, t)
    for nodes in forest.values():
        for leaf, steps in _paths(nodes):
            mix = nodes[leaf]["mix"]
            value = mix[1] / sum(mix) / len(forest)
            spans: dict[int, list[float]] = {}
            reach = 1.0
            for n, left in steps:
                child = nodes[n["left"] if left else n["right"]]
                ratio = sum(child["mix"]) / sum(n["mix"])
                s = spans.setdefault(t.cols.index(n["feature"]), [-math.inf, math.inf, 1.0])
                if left:
                    s[1] = min(s[1], n["threshold"])
                else:
                    s[0] = max(s[0], n["threshold"])
                s[2] *= ratio
                reach *= ratio
            base += value * reach
            games.append((value, [(i, *s) for i, s in sorted(spans.items())]))
    return games, base


def _path_tables(value: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with the same m features on their paths, by (feature, leaf, which of them a row is inside of)."""
    n, m = cover.shape
    weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = np.empty((m, n, 1 << m))
    for mask in range(1 << m):
        inside = [float(mask >> j & 1) for j in range(m)]
        for j in range(m):
            poly = [np.ones(n)]  # coefficient k: subsets of k known features among the others
            for o in range(m):
                if o == j:
                    continue
                grown = [p * cover[:, o] for p in poly] + [np.zeros(n)]
                for k, p in enumerate(poly):
                    grown[k + 1] = grown[k + 1] + p * inside[o]
                poly = grown
            out[j, :, mask] = value * (inside[j] - cover[:, j]) * sum(w * p for w, p in zip(weights, poly))
    return out


def _leaf_phi(x: np.ndarray, value: float, path) -> dict[int, np.ndarray]:
    """One leaf of a long path: the same sums over the rows instead of a table."""
    m = len(path)
    inside = [((x[:, i] > lo) & (x[:, i] <= hi)).astype(float) for i, lo, hi, _ in path]
    weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = {}
    for j, (i, _, _, cover) in enumerate(path):
        poly = [np.ones(len(x))]
        for o, (_, _, _, c) in enumerate(path):
            if o == j:
                continue
            grown = [p * c for p in poly] + [np.zeros(len(x))]
            for k, p in enumerate(poly):
                grown[k + 1] = grown[k + 1] + p * inside[o]
            poly = grown
        out[i] = value * (inside[j] - cover) * sum(w * p for w, p in zip(weights, poly))
    return out


def _shapley(x: np.ndarray, games) -> np.ndarray:
    """Path-dependent Shapley values of class 1. A leaf is a product game over its path's features: inside
    its interval a feature contributes 1 when known and its cover ratio when not.

    So a row's share of a leaf depends only on the set of features whose intervals hold it; leaves of short paths look it up.
    """
    phi = np.zeros(x.shape)
    alike: dict[tuple, list] = {}
    for value, path in games:
        if not path or value == 0.0:
            continue
        if len(path) > TABLE_FEATURES:
            for i, v in _leaf_phi(x, value, path).items():
                phi[:, i] += v
        else:
            alike.setdefault(tuple(i for i, *_ in path), []).append((value, path))
    for features, leaves in alike.items():
        m = len(features)
        step = max(1, TABLE_CELLS // (m << m))
        places = [np.unique(x[:, i], return_inverse=True) for i in features]
        for a in range(0, len(leaves), step):
            some = leaves[a : a + step]
            spans = np.array([[s[1:] for s in path] for _, path in some])
            table = _path_tables(np.array([v for v, _ in some]), spans[:, :, 2])
            sides = [(u[:, None] > spans[:, j, 0]) & (u[:, None] <= spans[:, j, 1]) for j, (u, _) in enumerate(places)]
            sides = [s.astype(np.uint8) << j for j, s in enumerate(sides)]
            start = np.arange(len(some)) << m
            rows = max(1, TABLE_CELLS // len(some))
            for r in range(0, len(x), rows):
                mask = np.zeros((len(x[r : r + rows]), len(some)), dtype=np.uint8)
                for (_, at), side in zip(places, sides):
                    mask += side[at[r : r + rows]]
                spot = mask + start
                for i, values in zip(features, table):
                    phi[r : r + rows, i] += values.ravel().take(spot).sum(axis=1)
    return phi


def _with_phi(points: DataFrame, games, base: float) -> DataFrame:
    """Points ``(x, w)`` with their Shapley values, dealt over tasks by the work they are: a few rows meet every leaf."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(games)  # at most trees x 2^depth leaves
    points = cut_lineage(points)
    work = points.count() * max(1, len(games))
    parts = max(1, -(-work // TASK_WORK))

    def run(batches):
        for b in batches:
            if len(b):
                phi = _shapley(np.stack(b["x"].to_numpy()), shared.value)
                yield b.assign(base=base, phi=list(phi))

    return points.repartition(parts).mapInPandas(run, "x array<double>, w long, base double, phi array<double>")


def shap_values(df: DataFrame, t: Trees) -> DataFrame:
    """``(row point, weight, base, phi)`` per distinct feature combination."""
    x = F.array(*[F.col(c).cast("double") for c in t.cols])
    points = df.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("w"))
    return _with_phi(points, *_leaf_games(df.sparkSession, t))


def threshold_cells(df: DataFrame, cols: Sequence[str], games) -> DataFrame:
    """``(x, w)``: rows that no threshold of the leaves parts are one point, at the upper ends of its intervals."""
    cuts: list[set] = [set() for _ in cols]
    for _, path in games:
        for i, lo, hi, _ in path:
            cuts[i].update(v for v in (lo, hi) if math.isfinite(v))
    ends = []
    for c, some in zip(cols, cuts):
        v, ascending = F.col(c).cast("double"), sorted(some)
        upper = leading([F.lit(e) < v for e in ascending], [F.lit(e) for e in [*ascending, math.inf]])
        ends.append(F.when(v.isNull() | F.isnan(v), v).otherwise(upper))
    return df.select(F.array(*ends).alias("x")).groupBy("x").agg(F.count("*").alias("w"))


def shap_importance(df: DataFrame, t: Trees) -> DataFrame:
    """Mean absolute Shapley value per feature over all rows. Work grows with the cells between thresholds (fewer than
    ``maxBins`` a feature) that rows lie in, not with the rows."""
    games, base = _leaf_games(df.sparkSession, t)
    names = F.array(*[F.lit(c) for c in t.cols])
    long = _with_phi(threshold_cells(df, t.cols, games), games, base).select("w", F.posexplode("phi").alias("j", "v"))
    return long.groupBy(F.get(names, F.col("j")).alias("feature")).agg((F.sum(F.abs("v") * F.col("w")) / F.sum("w")).alias("importance"))


# --- baseline ------------------------------------------------------------------------------------


def baseline_model(df: DataFrame, cols: Sequence[str], y: str, id_col: str, cap: int | None = None, trees: int = 100, depth: int = 10, seed: int = 42):
    """Standardize, optionally cap (stratified), 75/25 stratified split, fit a forest: ``(scored test rows, model)``."""
    data = standardize(df.select(id_col, y, *cols), cols)
    if cap:
        data = capped_stratified(data, id_col, y, cap, seed)
    parts = cut_lineage(train_test(data, id_col, 0.25, y, seed))
    model = tree_model(parts.filter("part = 'train'"), cols, y, trees=trees, depth=depth, seed=seed)
    return predict(parts.filter("part = 'test'"), model), model


def baseline_report(df: DataFrame, cols: Sequence[str], y: str, id_col: str, **kw) -> DataFrame:
    """Accuracy, class report, confusion and ROC area of the baseline as ``(section, name, value)`` rows."""
    scored, _ = baseline_model(df, cols, y, id_col, **kw)
    scored = cut_lineage(scored)
    report = mt.class_report(scored, y, "pred").unpivot(["class"], ["precision", "recall", "f1"], "m", "value")
    out = report.select(F.col("class").alias("section"), F.col("m").alias("name"), "value")
    conf = mt.confusion(scored, y, "pred").unpivot([], ["tn", "fp", "fn", "tp"], "name", "value")
    out = out.unionByName(conf.select(F.lit("confusion").alias("section"), "name", F.col("value").cast("double").alias("value")))
    auc = mt.roc_auc(scored, "score", y).select(F.lit("ranking").alias("section"), F.lit("roc_auc").alias("name"), F.col("roc_auc").alias("value"))
    return out.unionByName(auc)
