"""Density models: DBSCAN with deterministic border points, and Gaussian kernel log-density."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.operators.features import label_codes
from oddrows.operators.neighbors import attach_points, blockwise, coordinates, distinct_points, sq_distances
from oddrows.session import BROADCAST_ROWS, BROADCAST_ROWS_KEY, at_most, cut_lineage, setting

LOCAL_POINTS = 2000  # points that one task labels by itself when many settings are tried


def dbscan(df: DataFrame, xs: Sequence[str], id_col: str, eps: float, min_samples: int, out: str = "cluster") -> DataFrame:
    """Density clusters 0, 1, ... in order of their smallest core key; noise is -1.

    Works on distinct weighted points. Per tile, core points within reach are merged locally and only a
    spanning star is emitted (at most one edge per point and tile), never all close pairs. A border point
    joins its neighbouring cluster with the smallest number.
    """
    points = cut_lineage(distinct_points(df, xs, id_col))
    labels = dbscan_points(points, eps, min_samples).withColumnRenamed("label", out)
    at = cut_lineage(points.select("pid", "x").join(labels, "pid").drop("pid"))
    base = df.drop(out) if out in df.columns else df
    return attach_points(base, at, xs).withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("long"))


def dbscan_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``(pid, label)`` for weighted points ``(pid, w, x)``."""
    e2 = eps * eps
    q = points.withColumnRenamed("pid", "qid")

    def near_weight(qp, rp, d2):
        return pd.DataFrame({"qid": qp["qid"].to_numpy(), "n": ((d2 <= e2) * rp["w"].to_numpy(dtype=float)).sum(axis=1)})

    weight = blockwise(q.select("qid", "x"), points, near_weight, "qid long, n double", radius=eps)
    around = weight.groupBy("qid").agg(F.sum("n").alias("n"))
    marked = cut_lineage(q.join(around, "qid").withColumn("core", F.col("n") >= min_samples))
    core = marked.filter("core").select(F.col("qid").alias("pid"), "w", "x")

    def stars(qp, rp, d2):
        a, b = qp["qid"].to_numpy(), rp["pid"].to_numpy()
        close = d2 <= e2
        la, lb = a.copy(), b.copy()
        big = np.iinfo(np.int64).max
        while True:
            nb = np.minimum(lb, np.where(close, la[:, None], big).min(axis=0))
            na = np.minimum(la, np.where(close, nb[None, :], big).min(axis=1))
            if np.array_equal(na, la) and np.array_equal(nb, lb):
                break
            la, lb = na, nb
        u, v = np.concatenate([a, b]), np.concatenate([la, lb])
        keep = u != v
        return pd.DataFrame({"u": u[keep], "v": v[keep]}).drop_duplicates()

    edges = blockwise(core.withColumnRenamed("pid", "qid").select("qid", "x"), core, stars, "u long, v long", radius=eps)
    comp = components(edges.distinct())
    roots = core.select("pid", "w", "x").join(comp, "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    roots = cut_lineage(roots)
    codes = label_codes(roots, "root").select(F.col("value").alias("root"), F.col("code").alias("label"))

    def lowest(qp, rp, d2):
        root = np.where(d2 <= e2, rp["root"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        hit = root != np.iinfo(np.int64).max
        return pd.DataFrame({"qid": qp["qid"].to_numpy()[hit], "root": root[hit]})

    loose = marked.filter("not core").select("qid", "x")
    border = blockwise(loose, roots, lowest, "qid long, root long", radius=eps).groupBy("qid").agg(F.min("root").alias("root"))
    owned = roots.select("pid", "root").unionByName(border.select(F.col("qid").alias("pid"), "root"))
    named = owned.join(codes, "root").select("pid", "label")
    return points.select("pid").join(named, "pid", "left").withColumn("label", F.coalesce("label", F.lit(-1)).cast("long"))


def dbscan_settings(points: DataFrame, settings: Sequence[tuple[float, int]]) -> DataFrame:
    """Labels of the same points (pid, w, x) under several (eps, min_samples): pid, then ``c0``, ``c1`` ...

    Points that fit one task, up to ``LOCAL_POINTS``, are labelled there, a task for each setting; others by ``dbscan_points``, one setting
    after the other. The labels are the same.
    """
    out = points.select("pid")
    if not at_most(points, LOCAL_POINTS):
        for i, (eps, m) in enumerate(settings):
            out = out.join(cut_lineage(dbscan_points(points, eps, m)).withColumnRenamed("label", f"c{i}"), "pid", "left")
        return out
    values = [(float(eps), int(m)) for eps, m in settings]

    def label(found: pd.DataFrame) -> pd.DataFrame:
        eps, m = values[int(found["setting"].iloc[0])]
        found = found.sort_values("pid", ignore_index=True)
        return pd.DataFrame({"setting": found["setting"], "pid": found["pid"], "label": _local_labels(coordinates(found), found["w"].to_numpy(dtype=float), eps, m)})

    dealt = points.select("pid", "w", "x", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("setting"))
    labels = dealt.groupBy("setting").applyInPandas(label, "setting int, pid long, label long")
    wide = labels.groupBy("pid").pivot("setting", list(range(len(values)))).agg(F.first("label"))
    return wide.select("pid", *[F.col(f"`{i}`").alias(f"c{i}") for i in range(len(values))])


def _local_labels(x: np.ndarray, w: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """DBSCAN labels of points in the order of their keys."""
    near = sq_distances(x, x) <= eps * eps
    core = near @ w >= min_samples
    label = np.full(len(x), -1, np.int64)
    count = 0
    for first in np.flatnonzero(core):
        if label[first] >= 0:
            continue
        front = np.array([first])
        while len(front):
            label[front] = count
            front = np.flatnonzero(near[front].any(axis=0) & core & (label < 0))
        count += 1
    for k in np.flatnonzero(~core):
        around = label[near[k] & core]
        label[k] = around.min() if len(around) else -1
    return label


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable key per node ``(pid, root)`` of undirected edges ``(u, v)``.

    A checked small edge list is merged in one go; a large one by alternating large-star and small-star
    rounds (Kiveris et al. 2014), each written to the shared folder so lineage does not grow.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.filter("u <> v"))
    if at_most(edges, setting(spark, BROADCAST_ROWS_KEY, BROADCAST_ROWS)):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in edges.collect():
            a, b = find(r["u"]), find(r["v"])
            if a != b:
                parent[max(a, b)] = min(a, b)
        return spark.createDataFrame([(k, find(k)) for k in list(parent)], "pid long, root long")
    current, mark = edges, None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        current = cut_lineage(small.filter("u <> v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    leaves = current.select(F.col("u").alias("pid"), F.col("v").alias("root"))
    return leaves.unionByName(current.select(F.col("v").alias("pid"), F.col("v").alias("root")).distinct())


def kde_logdensity(df: DataFrame, xs: Sequence[str], id_col: str, bandwidth: float = 0.5, out: str = "log_density") -> DataFrame:
    """Gaussian kernel log-density of every row under all rows.

    Kernel values past 39 bandwidths are exactly zero in double precision, so those cells are skipped.
    """
    points = cut_lineage(distinct_points(df, xs, id_col))
    n = points.agg(F.sum("w")).first()[0] or 0
    scale = -0.5 / (bandwidth * bandwidth)

    def sums(qp, rp, d2):
        e = d2 * scale
        top = e.max(axis=1)
        s = (np.exp(e - top[:, None]) * rp["w"].to_numpy(dtype=float)[None, :]).sum(axis=1)
        return pd.DataFrame({"qid": qp["qid"].to_numpy(), "top": top, "s": s})

    q = points.select(F.col("pid").alias("qid"), "x")
    part = blockwise(q, points, sums, "qid long, top double, s double", radius=39.0 * bandwidth)
    best = part.groupBy("qid").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "s")).alias("all"))  # one per tile
    total = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp(x["top"] - F.col("m")))
    norm = math.log(max(1, n)) + len(xs) * (math.log(bandwidth) + 0.5 * math.log(2 * math.pi))
    dens = best.select("qid", (F.col("m") + F.ln(total) - F.lit(norm)).alias(out))
    at = cut_lineage(q.join(dens, "qid").drop("qid"))
    return attach_points(df, at, xs)
