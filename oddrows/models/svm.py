"""One-class boundary with a radial kernel.

The kernel is replaced by the inner product of a landmark (Nystroem) map, phi(x) = K(x, L) K(L, L)^(-1/2). Landmarks are added where
the map misses most, until the missed share of the kernel's diagonal, measured over all rows, is small enough. The problem is then
solved in the space of the landmarks by Newton steps; a step is one pass that sums value, gradient and curvature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.models.common import summed, training_points
from oddrows.operators.neighbors import coordinates, on_points, sq_distances
from oddrows.operators.order import order_statistics

FIRST_LANDMARKS, CANDIDATES = 128, 512
STEP_ROWS = 4096  # rows lifted at a time
LENGTHS = (1.0, 0.6, 0.3, 0.1, 0.03)  # of a Newton step
LAST_WIDTH = 1e-2  # rounding of the hinge at the end, as a share of the offset


@dataclass
class Boundary:
    cols: list[str]
    gamma: float
    landmarks: np.ndarray
    coef: np.ndarray  # weights of the kernels around the landmarks
    rho: float
    error: float  # missed share of the kernel's diagonal
    passes: int = 0

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * sq_distances(x, self.landmarks)) @ self.coef


def _map_of(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """What kernels around the landmarks are multiplied by: the inverse root of their own kernel matrix."""
    values, vectors = np.linalg.eigh(np.exp(-gamma * sq_distances(landmarks, landmarks)))
    live = values > 1e-10 * values[-1]
    return vectors[:, live] / np.sqrt(values[live])


def _lift(x: np.ndarray, landmarks: np.ndarray, mix: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * sq_distances(x, landmarks)) @ mix


def _landmarks(points: DataFrame, gamma: float, n: float, most: int, error: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Landmarks, their map, and the missed share; the number doubles until that is at most ``error`` or ``most`` are there."""
    chosen = coordinates(points.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(min(FIRST_LANDMARKS, most)).toPandas())
    while True:
        mix = _map_of(chosen, gamma)

        def missed(x, chosen=chosen, mix=mix):
            return np.concatenate([1.0 - (_lift(x[i : i + STEP_ROWS], chosen, mix, gamma) ** 2).sum(axis=1) for i in range(0, len(x), STEP_ROWS)])

        total = float(summed(points, lambda b: np.array([(np.maximum(0.0, missed(coordinates(b))) * b["w"].to_numpy(dtype=float)).sum()]), 1)[0]) / n
        if total <= error or len(chosen) >= most:
            return chosen, mix, total

        def worst(batches):
            for b in batches:
                if len(b):
                    r = missed(coordinates(b))
                    at = np.argsort(-r, kind="stable")[:CANDIDATES]
                    yield pd.DataFrame({"pid": b["pid"].to_numpy()[at], "x": b["x"].to_numpy()[at], "r": r[at]})

        found = points.mapInPandas(worst, "pid long, x array<double>, r double").orderBy(F.desc("r"), "pid").limit(CANDIDATES).toPandas()
        # one after the other, each the worst after those before
        x, left = coordinates(found), found["r"].to_numpy().copy()
        lifted = _lift(x, chosen, mix, gamma)
        kernel = np.exp(-gamma * sq_distances(x, x)) - lifted @ lifted.T
        added = []
        while len(added) < min(len(chosen), most - len(chosen)) and left.max(initial=0.0) > 1e-9:
            at = int(left.argmax())
            added.append(at)
            column = kernel[:, at] / math.sqrt(max(kernel[at, at], 1e-12))
            kernel = kernel - np.outer(column, column)
            left = np.maximum(0.0, np.diag(kernel)).copy()
            left[added] = 0.0
        if not added:
            return chosen, mix, total
        chosen = np.vstack([chosen, x[added]])


def svm_fit(
    df: DataFrame, cols: Sequence[str], id_col: str, nu: float = 0.01, gamma: float | None = None, landmarks: int = 256, error: float = 1e-3, passes: int = 24,
    seed: int = 42, tol: float = 1e-6,
) -> Boundary:
    """The one-class problem: a half space that holds all but a share ``nu`` of the lifted rows, as far from the origin as can be.

    Its hinge is rounded over a width that shrinks to a hundredth of the offset; a pass judges several lengths of a Newton step. ``gamma`` defaults to 1 / (columns * variance). The
    offset is set last, exactly: the nu-quantile of the training projections. ``error`` and ``landmarks`` bound the map; the
    missed share that was reached is reported in the model.
    """
    cols = list(cols)
    points = training_points(df, cols, id_col)
    d = len(cols)

    def moments(b):
        x, w = coordinates(b), b["w"].to_numpy(dtype=float)
        return np.array([w.sum(), (w[:, None] * x).sum(), (w[:, None] * x * x).sum()])

    n, s1, s2 = summed(points, moments, 3)
    var = s2 / (n * d) - (s1 / (n * d)) ** 2
    gamma = gamma or 1.0 / (d * var if var > 0 else 1.0)
    chosen, mix, missed = _landmarks(points, gamma, n, landmarks, error, seed)
    m = mix.shape[1]

    def mean(b):
        return (_lift(coordinates(b), chosen, mix, gamma) * b["w"].to_numpy(dtype=float)[:, None]).sum(axis=0)

    weight = summed(points, mean, m) / n
    rho = 0.5 * float(weight @ weight)
    upper = np.triu_indices(m)
    size = 2 + m + len(upper[0]) + m + 1

    def parts(b, weights, rhos, width):
        """For each candidate the sums of loss, slope at the offset, slope and curvature along the map, curvature at the offset."""
        x, w = coordinates(b), b["w"].to_numpy(dtype=float)
        out = np.zeros((len(rhos), size))
        for i in range(0, len(x), STEP_ROWS):
            z, rows = _lift(x[i : i + STEP_ROWS], chosen, mix, gamma), w[i : i + STEP_ROWS]
            for k, t in enumerate((rhos[:, None] - weights @ z.T)):
                near = (t > 0) & (t < width)
                slope = np.clip(t / width, 0.0, 1.0) * rows
                out[k, 0] += (rows * np.where(near, t * t / (2 * width), np.where(t > 0, t - width / 2, 0.0))).sum()
                out[k, 1] += slope.sum()
                out[k, 2 : 2 + m] += slope @ z
                bend, some = rows[near] / width, z[near]
                out[k, 2 + m : 2 + m + len(upper[0])] += ((some * bend[:, None]).T @ some)[upper]
                out[k, -m - 1 : -1] += bend @ some
                out[k, -1] += bend.sum()
        return out.ravel()

    width, used = 0.5 * max(rho, 1e-9), 0
    weights, rhos = weight[None, :], np.array([rho])
    while used < passes:
        used += 1
        found = summed(points, lambda b, at=(weights, rhos, width): parts(b, *at), size * len(rhos)).reshape(-1, size) / (nu * n)
        values = 0.5 * (weights**2).sum(axis=1) - rhos + found[:, 0]
        at = int(values.argmin())
        weight, rho, best = weights[at], float(rhos[at]), found[at]
        grad = np.append(weight - best[2 : 2 + m], best[1] - 1.0)
        last = LAST_WIDTH * max(rho, 1e-9)
        settled = np.linalg.norm(grad) <= tol or (used > 1 and values[0] - values[at] <= 1e-5 * abs(values[at]) and at > 0)
        if settled and width <= 1.01 * last:
            break
        curve = np.zeros((m + 1, m + 1))
        curve[upper] = best[2 + m : 2 + m + len(upper[0])]
        curve[:m, :m] += np.triu(curve[:m, :m], 1).T + np.eye(m)
        curve[:m, m] = curve[m, :m] = -best[-m - 1 : -1]
        curve[m, m] = best[-1] + 1e-9
        step = -np.linalg.solve(curve, grad)
        # where no row is near the offset there is no curvature; the offset must not run away
        step = step * min(1.0, max(abs(rho), float(weight @ weight), 1e-6) / max(1e-300, abs(step[-1])))
        if np.linalg.norm(grad) <= 0.5 and width > last:
            width = max(width / 2.5, last)
        lengths = np.array([0.0, *(LENGTHS if at or used == 1 else [x / 30 for x in LENGTHS])])
        weights, rhos = weight + lengths[:, None] * step[None, :-1], rho + lengths * step[-1]
    model = Boundary(cols, gamma, chosen, mix @ weight, 0.0, missed, used)
    fitted = svm_score(df, model, "_s").select(F.col(id_col), (-F.col("_s")).alias("_s"))
    row = order_statistics(fitted, "_s", lambda s: {k: [max(1, math.ceil(nu * v))] for k, v in s.items()}).first()
    model.rho = float(row["value"])
    return model


def svm_score(df: DataFrame, model: Boundary, out: str = "score") -> DataFrame:
    """offset - projection: positive outside the boundary."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        block = np.stack(x.to_numpy())
        return pd.Series(np.concatenate([model.rho - model.project(block[i : i + STEP_ROWS]) for i in range(0, len(block), STEP_ROWS)]))

    return on_points(df, model.cols, lambda d: d.withColumn(out, score("_x")))


def one_class_svm(df: DataFrame, cols: Sequence[str], id_col: str, fit_on: DataFrame | None = None, **kw) -> DataFrame:
    return svm_score(df, svm_fit(fit_on if fit_on is not None else df, cols, id_col, **kw))
