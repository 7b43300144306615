"""Isolation forest: one small seeded sample per tree, trees grown in parallel, scoring by a broadcast forest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.columns import seeded_key
from oddrows.operators.neighbors import point

EULER = 0.5772156649015329


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass
class Forest:
    cols: list[str]
    nodes: np.ndarray  # rows: tree, node, feature (-1 leaf), threshold, left, right, depth value
    sub: int


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    rows, stack = [], [(np.arange(len(x)), 0, 0)]
    made = 1
    while stack:
        idx, depth, me = stack.pop()
        spread = np.nonzero(x[idx].max(axis=0) > x[idx].min(axis=0))[0] if len(idx) > 1 else []
        if depth >= limit or len(spread) == 0:
            rows.append((me, -1, 0.0, -1, -1, depth + float(average_path(len(idx)))))
            continue
        f = int(rng.choice(spread))
        lo, hi = x[idx, f].min(), x[idx, f].max()
        cut = float(rng.uniform(lo, hi))
        go = x[idx, f] <= cut
        rows.append((me, f, cut, made, made + 1, 0.0))
        stack += [(idx[go], depth + 1, made), (idx[~go], depth + 1, made + 1)]
        made += 2
    return rows


def _tree_samples(df: DataFrame, id_col: str, n: int, trees: int, sub: int, seed: int) -> DataFrame:
    """``(tree, rows)`` of ``min(sub, n)`` rows each: every tree draws its own, in one way on tables of any size.

    A row is a candidate of the trees whose hash of it is low enough, about ``2 * sub`` a tree; the first ``sub`` of those by
    the seeded order stay.
    """
    odds = int(min(1.0, (2.0 * sub + 64) / max(1, n)) * (1 << 40))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), t, id_col), F.lit(1 << 40)) < odds)
    every = df.withColumn("tree", F.explode(mine))
    w = Window.partitionBy("tree").orderBy(seeded_key(seed, "tree", id_col), id_col)
    return every.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= sub).drop("_n")


def isolation_fit(df: DataFrame, cols: Sequence[str], id_col: str, trees: int = 100, sub: int = 256, seed: int = 42) -> Forest:
    cols = list(cols)
    rows = df.select(id_col, point(cols).alias("x"))
    n = rows.count()
    sub = min(sub, n)  # what a tree really holds sets its depth limit and the normal path length
    drawn = _tree_samples(rows, id_col, n, trees, sub, seed)
    limit = math.ceil(math.log2(max(2, sub)))

    def grow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(id_col)
        tree = int(p["tree"].iloc[0])
        rows = _grow(np.stack(p["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *r) for r in rows], columns=["tree", "node", "feature", "cut", "l", "r", "depth"])

    schema = "tree int, node int, feature int, cut double, l int, r int, depth double"
    # small rows, heavy work: keep one task per slot instead of letting the shuffle coalesce
    spread = min(trees, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    nodes = drawn.repartition(spread, "tree").groupBy("tree").applyInPandas(grow, schema).toPandas()
    nodes = nodes.sort_values(["tree", "node"])
    return Forest(cols, nodes.to_numpy(dtype=float), max(2, sub))


def isolation_score(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """2^(-mean depth / c(sub)): near 1 for rows that are isolated early."""
    trees = []
    for t in np.unique(forest.nodes[:, 0]):
        n = forest.nodes[forest.nodes[:, 0] == t]
        trees.append((n[:, 2].astype(int), n[:, 3], n[:, 4].astype(int), n[:, 5].astype(int), n[:, 6]))
    shared = df.sparkSession.sparkContext.broadcast(trees)  # at most trees x (2 * sub - 1) nodes
    norm = float(average_path(forest.sub))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        block, back = np.unique(np.stack(x.to_numpy()), axis=0, return_inverse=True)
        rows = np.arange(len(block))
        total = np.zeros(len(block))
        for feature, cut, left, right, depth in shared.value:
            at = np.zeros(len(block), dtype=int)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                low = block[rows, np.where(go, f, 0)] <= cut[at]
                at = np.where(go, np.where(low, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(shared.value) / norm)[back.ravel()])

    return df.withColumn(out, score(point(forest.cols)))


def isolation_forest(df: DataFrame, cols: Sequence[str], id_col: str, fit_on: DataFrame | None = None, **kw) -> DataFrame:
    return isolation_score(df, isolation_fit(fit_on if fit_on is not None else df, cols, id_col, **kw))
