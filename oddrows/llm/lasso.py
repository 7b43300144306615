"""Logistic regression with an absolute penalty: on a bounded matrix in the driver, or on sparse rows by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrows.models.common import summed

PASS_ROWS = 1024  # rows that are spread over all columns at once


def fit_lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps on the mean log loss; the intercept is not penalized.

    With no rows, or one class only, the weights are 0 and the intercept is that of the smoothed share of ones.
    """
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max() or x.shape[1] == 0:
        return start, np.zeros(x.shape[1])
    x = x.astype(np.float32, copy=False)
    # the largest eigenvalue of the curvature, by power iteration with the constant column
    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(30):
        u = x @ v[1:] + v[0]
        v = np.concatenate([[u.sum()], x.T @ u])
        size = np.linalg.norm(v)
        v /= size
    step = 4 * n / (1.05 * size)
    w, b = np.zeros(x.shape[1]), start
    z, c, t = w, b, 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(x @ z.astype(np.float32) + np.float32(c)))) - y
        moved = z - step * (x.T @ gap.astype(np.float32)) / n
        w_next = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b_next = c - step * float(gap.mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t_next
        z, c = w_next + k * (w_next - w), b_next + k * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return b, w


def fit_sparse_lasso(rows: DataFrame, size: int, penalty: float, passes: int = 25, tolerance: float = 1e-4) -> tuple[float, np.ndarray]:
    """The same model over all ``rows`` (``label``, places ``has`` of the ones among ``size`` columns, number ``w`` of such rows).

    Newton steps: each takes one pass over the rows, from which the sums of the gradient and the curvature reach the driver, where the
    penalized quadratic is solved column by column. A step that raises the loss is halved.
    """
    n, ones = rows.agg(F.sum("w"), F.sum(F.col("w") * (F.col("label") > 0).cast("long"))).first()
    n, ones = n or 0, ones or 0
    share = (ones + 0.5) / (n + 1)
    start = np.concatenate([np.zeros(size), [np.log(share / (1 - share))]])
    if ones in (0, n) or size == 0:
        return float(start[-1]), start[:-1]
    k = size + 1  # the last column is constant

    def sums_at(beta: np.ndarray):
        def sums(b):
            out = np.zeros(k * k + k + 1)
            for at in range(0, len(b), PASS_ROWS):
                part = b.iloc[at : at + PASS_ROWS]
                has = [np.append(h, size).astype(np.int64) for h in part["has"]]
                lengths = np.array([len(h) for h in has])
                flat, row = np.concatenate(has), np.repeat(np.arange(len(has)), lengths)
                y, w = (part["label"].to_numpy() > 0).astype(float), part["w"].to_numpy(dtype=float)
                z = np.bincount(row, beta[flat], minlength=len(has))
                p = 1 / (1 + np.exp(-z))
                out[k * k : -1] += np.bincount(flat, ((p - y) * w)[row], minlength=k)
                out[-1] += (w * (np.logaddexp(0, z) - y * z)).sum()
                dense = np.zeros((len(has), k), np.float32)
                dense[row, flat] = 1
                out[: k * k] += (dense.T @ (dense * (p * (1 - p) * w).astype(np.float32)[:, None])).ravel()
            return out

        found = summed(rows, sums, k * k + k + 1) / n
        return found[: k * k].reshape(k, k), found[k * k : -1], float(found[-1])

    beta, now, worth = start, start, np.inf
    for _ in range(passes):
        curve, slope, loss = sums_at(now)
        value = loss + penalty * np.abs(now[:-1]).sum()
        if value > worth + 1e-12:
            now = (beta + now) / 2
            if np.abs(now - beta).max() < tolerance:
                break
            continue
        beta, worth = now, value
        now = _quadratic_step(curve, slope, beta, penalty)
        if np.abs(now - beta).max() < tolerance:
            beta = now
            break
    return float(beta[-1]), beta[:-1]


def _quadratic_step(curve: np.ndarray, slope: np.ndarray, beta: np.ndarray, penalty: float, sweeps: int = 200) -> np.ndarray:
    """Least penalized quadratic around ``beta``, by sweeps over the columns; all of them, then those that are not 0."""
    new, rest = beta.copy(), slope.copy()  # rest: the slope at ``new``
    own = np.diag(curve) + 1e-9
    every, live = np.arange(len(beta)), None
    for _ in range(sweeps):
        most = 0.0
        for j in every if live is None else live:
            moved = new[j] - rest[j] / own[j]
            if j < len(beta) - 1:
                moved = np.sign(moved) * max(abs(moved) - penalty / own[j], 0.0)
            gap = moved - new[j]
            if gap:
                new[j] = moved
                rest += gap * curve[j]
                rest[j] += gap * 1e-9
                most = max(most, abs(gap))
        if most < 1e-6:
            if live is None:
                break
            live = None
        else:
            live = np.append(np.nonzero(new[:-1])[0], len(beta) - 1)
    return new
