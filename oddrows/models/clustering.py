"""k-means, Gaussian mixtures, fuzzy c-means, Ward clustering. All fit on distinct weighted points."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.columns import center_distances_array
from oddrows.models.common import summed, training_points
from oddrows.operators.neighbors import WIDE, attach_points, blockwise, coordinates, on_points, point, sq_distances, two_rounds
from oddrows.operators.sampling import sample_n
from oddrows.session import BROADCAST_ROWS, BROADCAST_ROWS_KEY, at_most, cut_lineage, setting

LITERAL_CELLS = 300  # centres x columns that still make a reasonable expression
FLAT_CENTERS = 64  # more are grouped around pivots
SEED_POINTS = 10_000  # distinct points of which starts are drawn
WARD_FINISH = 2000  # clusters whose remaining merges are made in one place


@dataclass
class Centers:
    cols: list[str]
    centers: np.ndarray
    cost: float = float("nan")


class TooFewPoints(ValueError):
    """More centres are asked for than there are distinct points."""


def nearest_center(df: DataFrame, cols: Sequence[str], centers: np.ndarray, out: str = "cluster", dist: str = "distance") -> DataFrame:
    """Index of and distance to the nearest centre. Few centres stay a native expression."""
    if centers.size <= LITERAL_CELLS:
        d = center_distances_array([*cols], centers.tolist())
        with_d = df.withColumn("_d", d).withColumn(dist, F.array_min("_d"))
        return with_d.withColumn(out, (F.array_position("_d", F.col(dist)) - 1).cast("int")).drop("_d")
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centers, dtype=float))

    @F.pandas_udf(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    def near(x: pd.Series) -> pd.DataFrame:
        index = CenterIndex(shared.value)
        best, far = [], []
        block = np.stack(x.to_numpy()) if len(x) else np.zeros((0, index.centers.shape[1]))
        step = max(1, 4_000_000 // len(index.centers))
        for i in range(0, len(block), step):
            label, d2 = index.nearest(block[i : i + step])
            best.append(label)
            far.append(np.sqrt(d2))
        return pd.DataFrame({"c": np.concatenate(best or [[]]).astype("int32"), "d": np.concatenate(far or [[]])})

    return df.withColumn("_n", near(point(cols))).withColumns({out: F.col("_n.c"), dist: F.col("_n.d")}).drop("_n")


class CenterIndex:
    """Nearest of many centres. They are grouped around some of them; a row looks only into groups that can hold a nearer one."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        count = int(math.sqrt(len(centers)))
        self.pivots = centers[:: max(1, len(centers) // max(1, count))][:count] if len(centers) > FLAT_CENTERS else None
        if self.pivots is not None:
            d = sq_distances(centers, self.pivots)
            home = d.argmin(axis=1)
            self.groups = [np.flatnonzero(home == j) for j in range(len(self.pivots))]
            self.reach = np.sqrt([d[g, j].max(initial=0.0) for j, g in enumerate(self.groups)])
            self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest centre (the first on ties) and squared distance, for a bounded block of rows."""
        if self.pivots is None and x.shape[1] >= WIDE:
            return self._nearest_wide(x)
        if self.pivots is None:
            d = sq_distances(x, self.centers)
            best = d.argmin(axis=1)
            return best, d[np.arange(len(x)), best]
        far = np.sqrt(sq_distances(x, self.pivots))
        own = far.argmin(axis=1)
        label, best = np.full(len(x), len(self.centers)), np.full(len(x), np.inf)

        def look(rows, j):
            group = self.groups[j]
            if not len(rows) or not len(group):
                return
            self.compared += len(rows) * len(group)
            d = sq_distances(x[rows], self.centers[group])
            at = d.argmin(axis=1)
            found, name = d[np.arange(len(rows)), at], group[at]
            better = (found < best[rows]) | ((found == best[rows]) & (name < label[rows]))
            best[rows[better]], label[rows[better]] = found[better], name[better]

        for j in range(len(self.pivots)):
            look(np.flatnonzero(own == j), j)
        for j in range(len(self.pivots)):
            gap = np.maximum(0.0, far[:, j] - self.reach[j]) * (1 - 1e-9) - 1e-12
            look(np.flatnonzero((own != j) & (np.maximum(gap, 0.0) ** 2 <= best)), j)
        return label, best

    def _nearest_wide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by a matrix product; centres that its rounding cannot tell apart are compared by their differences."""
        own, theirs = (x * x).sum(axis=1), (self.centers * self.centers).sum(axis=1)
        d = theirs - 2.0 * (x @ self.centers.T) + own[:, None]
        best = d.argmin(axis=1)
        bound = d[np.arange(len(x)), best] + 1e-12 * x.shape[1] * (own + theirs.max(initial=0.0))
        close = np.flatnonzero((~(d > bound[:, None])).sum(axis=1) > 1)
        if len(close):
            best[close] = sq_distances(x[close], self.centers).argmin(axis=1)
        d2 = np.zeros(len(x))
        for diff in np.ascontiguousarray((x - self.centers[best]).T):  # summed in the order of ``sq_distances``
            d2 += diff * diff
        return best, d2


def _blocks(b: pd.DataFrame, width: int):
    x, w = coordinates(b), b["w"].to_numpy(dtype=float)
    step = max(1, 2_000_000 // max(1, width))
    for i in range(0, len(x), step):
        yield x[i : i + step], w[i : i + step]


def _seeds(x: np.ndarray, w: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k centres of the sample, each drawn by weight and squared distance to those before."""
    total = np.cumsum(w)
    first = int(np.searchsorted(total, draw.random() * total[-1], side="right"))
    chosen = [min(first, len(x) - 1)]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = np.cumsum(w * near)
        if total[-1] > 0:
            at = min(int(np.searchsorted(total, draw.random() * total[-1], side="right")), len(x) - 1)
        else:
            at = int(np.setdiff1d(np.arange(len(x)), chosen)[0])
        chosen.append(at)
        near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
    return x[chosen]


def kmeans_models(points: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 42, max_iter: int = 300, starts: int = 10, tol: float = 1e-4) -> dict[int, Centers]:
    """The best of several starts for every k, all fitted by the same scans of the points (``training_points``).

    Starts are drawn from a sample of ``SEED_POINTS`` distinct points (or four per centre). A scan sums, for each model still moving, its
    points by centre; a model stops when its centres move by no more than ``tol`` times the mean variance of the columns,
    squared. A centre that loses all points stays. With fewer distinct points than k, each is a centre.
    """
    d = len(cols)
    most = max(ks)
    wanted = max(SEED_POINTS, 4 * most)
    sample = sample_n(points, "pid", wanted, seed).orderBy("pid").toPandas()
    if not len(sample):
        return {k: Centers(list(cols), np.zeros((0, d)), 0.0) for k in ks}
    x, w = coordinates(sample), sample["w"].to_numpy(dtype=float)
    mean = np.average(x, axis=0, weights=w)
    limit = tol * np.average((x - mean) ** 2, axis=0, weights=w).mean()
    models = {(k, s): _seeds(x, w, min(k, len(x)), np.random.default_rng([seed, k, s])) for k in ks for s in range(starts)}
    best: dict[int, Centers] = {}
    live = list(models)
    for step in range(max_iter + 1):
        sizes = [len(models[m]) * (d + 1) + 1 for m in live]
        ends = np.cumsum([0, *sizes])

        def sums(b, now=[models[m] for m in live], ends=ends):
            indexes = [CenterIndex(c) for c in now]
            out = np.zeros(ends[-1])
            for bx, bw in _blocks(b, max(len(c) for c in now)):
                for index, start in zip(indexes, ends):
                    k = len(index.centers)
                    label, d2 = index.nearest(bx)
                    part = out[start : start + k * (d + 1) + 1]
                    part[:k] += np.bincount(label, bw, minlength=k)
                    if d >= WIDE and k <= FLAT_CENTERS:
                        held = (label[:, None] == np.arange(k)) * bw[:, None]
                        part[k:-1] += (bx.T @ held).ravel()
                        part[-1] += (bw * d2).sum()
                        continue
                    for j in range(d):
                        part[k * (j + 1) : k * (j + 2)] += np.bincount(label, bw * bx[:, j], minlength=k)
                    part[-1] += (bw * d2).sum()
            return out

        found = summed(points, sums, int(ends[-1]))
        moving = []
        for m, start, end in zip(live, ends, ends[1:]):
            part, old = found[start:end], models[m]
            k = len(old)
            held = part[:k] > 0
            new = old.copy()
            new[held] = (part[k:-1].reshape(d, k).T)[held] / part[:k][held, None]
            if ((new - old) ** 2).sum() <= limit or step == max_iter:
                if m[0] not in best or part[-1] < best[m[0]].cost:
                    best[m[0]] = Centers(list(cols), old, float(part[-1]))
            else:
                models[m] = new
                moving.append(m)
        live = moving
        if not live:
            break
    return best


def kmeans_fit(df: DataFrame, cols: Sequence[str], k: int, id_col: str, seed: int = 42, max_iter: int = 300, starts: int = 10) -> Centers:
    return kmeans_models(training_points(df, cols, id_col), cols, [k], seed, max_iter, starts)[k]


def kmeans(df: DataFrame, cols: Sequence[str], k: int, id_col: str, seed: int = 42, starts: int = 10) -> tuple[DataFrame, Centers]:
    """Rows with ``cluster`` and ``distance`` to the centre, and the centres with the total squared distance."""
    model = kmeans_fit(df, cols, k, id_col, seed, starts=starts)
    return nearest_center(df, cols, model.centers), model


# --- Gaussian mixture ----------------------------------------------------------------------------


@dataclass
class Mixture:
    cols: list[str]
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray


def gmm_fit(df: DataFrame, cols: Sequence[str], k: int, id_col: str, seed: int = 42, max_iter: int = 50) -> Mixture:
    return gmm_of_points(training_points(df, cols, id_col), cols, k, seed, max_iter)


def gmm_of_points(points: DataFrame, cols: Sequence[str], k: int, seed: int = 42, max_iter: int = 50) -> Mixture:
    """The mixture of distinct weighted points."""
    points = points.withColumn("features", array_to_vector("x")).withColumn("w", F.col("w").cast("double"))
    model = GaussianMixture(k=k, seed=seed, weightCol="w", maxIter=max_iter, featuresCol="features").fit(points)
    g = model.gaussians
    return Mixture(
        list(cols), np.array(model.weights), np.array([x.mean.toArray() for x in g]), np.array([x.cov.toArray() for x in g])
    )


def gmm_score(df: DataFrame, model: Mixture) -> DataFrame:
    """Most likely component ``cluster`` and per-row ``log_likelihood``. Singular directions are ridged."""
    d = model.means.shape[1]
    shift = []
    for mean, cov in zip(model.means, model.covs):
        ridge = cov + np.eye(d) * 1e-6
        inv, (_, logdet) = np.linalg.inv(np.linalg.cholesky(ridge)), np.linalg.slogdet(ridge)
        shift.append((mean, inv, -0.5 * (logdet + d * math.log(2 * math.pi))))
    logw = np.log(np.maximum(model.weights, 1e-300))

    @F.pandas_udf(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("l", T.DoubleType())]))
    def score(x: pd.Series) -> pd.DataFrame:
        block = np.stack(x.to_numpy()) if len(x) else np.zeros((0, d))
        parts = np.stack(
            [lw + norm - 0.5 * (((block - mean) @ inv.T) ** 2).sum(axis=1) for lw, (mean, inv, norm) in zip(logw, shift)], axis=1
        )
        top = parts.max(axis=1, initial=-np.inf)
        return pd.DataFrame({"c": parts.argmax(axis=1).astype("int32"), "l": top + np.log(np.exp(parts - top[:, None]).sum(axis=1))})

    named = {"cluster": F.col("_s.c"), "log_likelihood": F.col("_s.l")}
    return on_points(df, model.cols, lambda d: d.withColumn("_s", score("_x")).withColumns(named).drop("_s"))


def gmm(df: DataFrame, cols: Sequence[str], k: int, id_col: str, seed: int = 42) -> DataFrame:
    return gmm_score(df, gmm_fit(df, cols, k, id_col, seed))


# --- fuzzy c-means -------------------------------------------------------------------------------


def _memberships(x: np.ndarray, centers: np.ndarray, m: float) -> np.ndarray:
    d2 = np.maximum(sq_distances(x, centers), np.finfo(float).eps ** 2)
    inv = (d2 / d2.min(axis=1, keepdims=True)) ** (-1.0 / (m - 1.0))
    return inv / inv.sum(axis=1, keepdims=True)


def fuzzy_models(
    points: DataFrame, cols: Sequence[str], cs: Sequence[int], m: float = 2.0, tol: float = 0.005, iters: int = 1000, seed: int = 42
) -> dict[int, Centers]:
    """For every number of centres, alternate memberships and centres until the membership matrix moves less than ``tol`` (Frobenius
    norm); all models share the scans of the points. Numbers above that of the distinct points are left out."""
    d = len(cols)
    drawn = {c: coordinates(sample_n(points, "pid", c, seed).toPandas()) for c in cs}
    now = {c: x for c, x in drawn.items() if len(x) == c}
    before: dict[int, np.ndarray | None] = dict.fromkeys(now)
    done: dict[int, Centers] = {}
    for _ in range(iters):
        live = [c for c in now if c not in done]
        if not live:
            break
        ends = np.cumsum([0, *[c * d + c + 1 for c in live]])

        def sums(b, models=[(now[c], before[c]) for c in live], ends=ends):
            x, w = coordinates(b), b["w"].to_numpy(dtype=float)
            parts = []
            for centers, previous in models:
                u = _memberships(x, centers, m)
                um = u**m * w[:, None]
                moved = 0.0 if previous is None else float((w[:, None] * (u - _memberships(x, previous, m)) ** 2).sum())
                parts.append(np.concatenate([(um.T @ x).ravel(), um.sum(axis=0), [moved]]))
            return np.concatenate(parts)

        found = summed(points, sums, int(ends[-1]))
        for c, start, end in zip(live, ends, ends[1:]):
            out = found[start:end]
            if before[c] is not None and math.sqrt(out[-1]) < tol:
                done[c] = Centers(list(cols), now[c])
            else:
                before[c], now[c] = now[c], out[: c * d].reshape(c, d) / out[c * d : c * d + c, None]
    return {c: done.get(c) or Centers(list(cols), x) for c, x in now.items()}


def fuzzy_fit(
    df: DataFrame, cols: Sequence[str], c: int, id_col: str, m: float = 2.0, tol: float = 0.005, iters: int = 1000, seed: int = 42
) -> Centers:
    """One model of ``fuzzy_models``."""
    points = training_points(df, cols, id_col)
    found = fuzzy_models(points, cols, [c], m, tol, iters, seed)
    if c not in found:
        raise TooFewPoints(f"{c} centres asked of {points.count()} distinct points")
    return found[c]


def fuzzy_score(df: DataFrame, model: Centers, m: float = 2.0) -> DataFrame:
    """Membership array ``u``, its largest entry and position; a native expression over literal centres."""
    floor = float(np.finfo(float).eps ** 2)
    power = 1.0 / (m - 1.0)
    dist = center_distances_array(model.cols, model.centers.tolist())
    inv = F.transform(dist, lambda x: F.pow(F.greatest(x * x, F.lit(floor)), F.lit(-power)))
    whole = F.aggregate("_i", F.lit(0.0), lambda s, v: s + v)
    out = df.withColumn("_i", inv).withColumn("_t", whole).withColumn("u", F.transform("_i", lambda v: v / F.col("_t")))
    out = out.withColumn("max_membership", F.array_max("u"))
    return out.withColumn("cluster", (F.array_position("u", F.col("max_membership")) - 1).cast("int")).drop("_i", "_t")


def fuzzy_cmeans(df: DataFrame, cols: Sequence[str], c: int, id_col: str, **kw) -> tuple[DataFrame, Centers]:
    model = fuzzy_fit(df, cols, c, id_col, **kw)
    return fuzzy_score(df, model, kw.get("m", 2.0)), model


# --- Ward ----------------------------------------------------------------------------------------


@dataclass
class WardTree:
    """Merges of all distinct points. Each merge ends one cluster, named by its smallest ``pid``, and so is named by it."""

    points: DataFrame  # x, w, pid
    rounds: list[DataFrame]  # keep, gone, height: pairs merged in one round
    last: list[tuple[int, int, float]]  # the merges after the rounds, in order
    survivors: list[int]  # clusters before the last merges

    def labels(self, ks: Sequence[int]) -> DataFrame:
        """``pid`` and, for each k, ``root_<k>``: the smallest key of the point's cluster when k clusters are left.

        The k - 1 highest merges are undone. Names are followed from the last round back to the first, so every round joins no more
        clusters than were left then.
        """
        spark = self.points.sparkSession
        logged = [(h, len(self.rounds) + i, gone) for i, (_, gone, h) in enumerate(self.last)]
        most = max(ks) - 1
        for i, merges in enumerate(self.rounds):
            logged += [(r["height"], i, r["gone"]) for r in merges.orderBy(F.desc("height"), "gone").limit(most).collect()]
        logged.sort(key=lambda m: (-m[0], -m[1]))
        undone = [{gone for _, _, gone in logged[: k - 1]} for k in ks]
        roots = {p: [p] * len(ks) for p in self.survivors}
        for keep, gone, _ in reversed(self.last):
            roots[gone] = [gone if gone in cut else root for cut, root in zip(undone, roots[keep])]
        names = [f"root_{k}" for k in ks]
        fields = ", ".join(f"{n} long" for n in names)
        now = spark.createDataFrame([(p, *r) for p, r in roots.items()], f"pid long, {fields}")
        for merges in reversed(self.rounds):
            met = merges.join(now.withColumnRenamed("pid", "keep"), "keep")
            cut = [F.when(F.col("gone").isin(sorted(c)), F.col("gone")).otherwise(F.col(n)).alias(n) for c, n in zip(undone, names)]
            now = cut_lineage(now.unionByName(met.select(F.col("gone").alias("pid"), *cut)))
        return now


def _ward_nearest(clusters: DataFrame) -> DataFrame:
    """Nearest other cluster by the increase in squares: qid, pid, d; the smallest key on ties."""

    def fn(q, r, d2):
        a, b = q["w"].to_numpy(dtype=float)[:, None], r["w"].to_numpy(dtype=float)[None, :]
        qid, pid = q["qid"].to_numpy(), r["pid"].to_numpy()
        order = np.argsort(pid, kind="stable")
        d = (d2 * (a * b / (a + b)))[:, order]
        d[qid[:, None] == pid[order][None, :]] = np.inf
        best = d.argmin(axis=1)
        found = d[np.arange(len(d)), best]
        live = np.isfinite(found)
        return pd.DataFrame({"qid": qid[live], "pid": pid[order][best][live], "d": found[live]})

    query = clusters.select(F.col("pid").alias("qid"), "x", "w")
    schema = "qid long, pid long, d double"
    limit = setting(clusters.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS)
    parts = blockwise(query, clusters, fn, schema) if at_most(clusters, limit) else two_rounds(query, clusters, 1, fn, schema, "d", ward=True)[0]
    return parts.groupBy("qid").agg(F.min(F.struct("d", "pid")).alias("m")).select("qid", "m.pid", "m.d")


def ward_tree(points: DataFrame, finish: int = WARD_FINISH) -> WardTree:
    """All Ward merges of weighted points (x, w, pid), exactly.

    Merging two clusters never brings the result nearer to a third one than the nearer of them was, so all pairs that are each
    other's nearest can merge at once and the tree stays that of merging one pair at a time. Rounds of such merges run on
    Spark until ``finish`` clusters are left, whose merges are made by chains of nearest neighbours on the driver. Points in a line
    with ever growing gaps have one such pair a round; other data lose a third of the clusters or so.
    """
    points = points.select("x", F.col("w").cast("double").alias("w"), "pid")
    now = points.withColumn("h", F.lit(0.0))
    left, rounds = now.count(), []
    while left > finish:
        near = cut_lineage(_ward_nearest(now.select("pid", "x", "w")))
        back = near.select(F.col("qid").alias("pid"), F.col("pid").alias("qid"))
        merges = near.filter("qid < pid").join(back, ["qid", "pid"]).select(F.col("qid").alias("keep"), F.col("pid").alias("gone"), "d")
        ended = now.select(F.col("pid").alias("gone"), F.col("x").alias("gx"), F.col("w").alias("gw"), F.col("h").alias("gh")).join(merges, "gone")
        joined = now.join(ended.withColumnRenamed("keep", "pid"), "pid", "left").join(merges.select(F.col("gone").alias("pid")), "pid", "left_anti")
        one = F.col("gone").isNull()
        mean = F.zip_with("x", "gx", lambda a, b: (a * F.col("w") + b * F.col("gw")) / (F.col("w") + F.col("gw")))
        # rounding must not put a merge below those that it contains
        now = cut_lineage(
            joined.select(
                "pid", F.when(one, F.col("x")).otherwise(mean).alias("x"), F.when(one, F.col("w")).otherwise(F.col("w") + F.col("gw")).alias("w"),
                F.when(one, F.col("h")).otherwise(F.greatest("d", "h", "gh")).alias("h"), "gone",
            )
        )
        rounds.append(now.filter("gone IS NOT NULL").select(F.col("pid").alias("keep"), "gone", F.col("h").alias("height")))
        now = now.drop("gone")
        left = now.count()
    rest = now.orderBy("pid").toPandas()
    last = _ward_chain(coordinates(rest), rest["w"].to_numpy(), rest["h"].to_numpy(), rest["pid"].to_numpy())
    return WardTree(points, rounds, last, [int(p) for p in rest["pid"]])


def _ward_chain(centers: np.ndarray, weights: np.ndarray, heights: np.ndarray, pids: np.ndarray) -> list[tuple[int, int, float]]:
    """Ward merges (keep, gone, height) of a few clusters, by chains of nearest neighbours; ``pids`` ascend."""
    c, w, h = centers.astype(float).copy(), weights.astype(float).copy(), heights.astype(float).copy()
    n = len(c)
    if n < 2:
        return []
    d = sq_distances(c, c) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, dtype=bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(live.argmax()))
        top = chain[-1]
        near = int(d[top].argmin())
        if len(chain) > 1 and d[top, chain[-2]] <= d[top, near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        i, j = min(top, near), max(top, near)
        height = max(d[i, j], h[i], h[j])
        merges.append((int(pids[i]), int(pids[j]), float(height)))
        c[i] = (c[i] * w[i] + c[j] * w[j]) / (w[i] + w[j])
        w[i], h[i] = w[i] + w[j], height
        live[j] = False
        d[j, :] = d[:, j] = np.inf
        row = ((c - c[i]) ** 2).sum(axis=1) * (w * w[i] / (w + w[i]))
        row[~live] = np.inf
        row[i] = np.inf
        d[i, :] = d[:, i] = row
        chain = chain[:-2]
    return merges


def hierarchical(df: DataFrame, cols: Sequence[str], k: int, id_col: str, finish: int = WARD_FINISH, tree: WardTree | None = None) -> tuple[DataFrame, Centers]:
    """Rows with their Ward ``cluster``, numbered by smallest key, and the cluster means. ``tree`` may be that of the same points.

    With fewer than k distinct points each is a cluster.
    """
    tree = tree or ward_tree(training_points(df, cols, id_col), finish)
    labels = tree.labels([k])
    roots = sorted(r[0] for r in labels.select(f"root_{k}").distinct().collect())
    numbers = F.broadcast(df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(roots)], f"root_{k} long, cluster int"))  # k rows
    placed = cut_lineage(tree.points.join(labels, "pid").join(numbers, f"root_{k}").select("x", "w", "cluster"))
    sums = [(F.sum(F.get("x", F.lit(i)) * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(len(cols))]
    means = [list(r)[1:] for r in placed.groupBy("cluster").agg(*sums).orderBy("cluster").collect()]
    return attach_points(df, placed.drop("w"), cols), Centers(list(cols), np.array(means, dtype=float).reshape(len(means), len(cols)))
