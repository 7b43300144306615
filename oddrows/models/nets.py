"""Autoencoder and variational autoencoder trained data-parallel.

Distinct weighted points are dealt to mini-batches by a hash of their key. A step sums the gradients of one mini-batch over all its
partitions and moves the shared weights by Adam on the driver, so the result does not hang on the partitions. Only
weight-sized sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.models.common import summed, training_points
from oddrows.operators.neighbors import coordinates, point
from oddrows.operators.sampling import train_test
from oddrows.session import cut_lineage

BATCHES = 8  # mini-batches of a round
PENALTY_ROWS = 200  # rows that share one unit of the weight penalty


def _shapes(sizes: Sequence[int]):
    return [(a, b) for a, b in zip(sizes, sizes[1:])]


def _unpack(theta: np.ndarray, shapes):
    out, at = [], 0
    for a, b in shapes:
        w = theta[at : at + a * b].reshape(a, b)
        at += a * b
        out.append((w, theta[at : at + b]))
        at += b
    return out


def _size(shapes) -> int:
    return sum(a * b + b for a, b in shapes)


def _init(shapes, rng) -> np.ndarray:
    parts = []
    for a, b in shapes:
        parts += [rng.normal(0, np.sqrt(2.0 / (a + b)), a * b), np.zeros(b)]
    return np.concatenate(parts)


def _forward(x, layers):
    """ReLU on all but the last layer; keeps the inputs of every layer."""
    seen = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
        seen.append(x)
    return seen


def _backward(seen, layers, grad):
    """Gradient of the parameters and of the input."""
    parts = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        if i < len(layers) - 1:
            grad = grad * (seen[i + 1] > 0)
        parts.append(np.concatenate([(seen[i].T @ grad).ravel(), grad.sum(axis=0)]))
        grad = grad @ w.T
    return np.concatenate(parts[::-1]), grad


@dataclass
class Net:
    cols: list[str]
    encoder: list[tuple[int, int]]
    decoder: list[tuple[int, int]]
    theta: np.ndarray
    latent: int
    kl_weight: float | None = None  # None: plain autoencoder
    history: list[float] = field(default_factory=list)

    def parts(self, theta=None):
        theta = self.theta if theta is None else theta
        n = _size(self.encoder)
        return _unpack(theta[:n], self.encoder), _unpack(theta[n:], self.decoder)


def _loss(net: Net, theta, x, w, noise=None):
    """Weighted loss sum and parameter gradient."""
    enc, dec = net.parts(theta)
    d = x.shape[1]
    es = _forward(x, enc)
    if net.kl_weight is None:
        ds = _forward(es[-1], dec)
        diff = ds[-1] - x
        loss = float((w * (diff**2).mean(axis=1)).sum())
        gd, gz = _backward(ds, dec, 2.0 * diff * w[:, None] / d)
        ge, _ = _backward(es, enc, gz)
        return loss, np.concatenate([ge, gd])
    mean, logvar = es[-1][:, : net.latent], np.clip(es[-1][:, net.latent :], -10.0, 10.0)
    sd = np.exp(0.5 * logvar)
    ds = _forward(mean + sd * noise, dec)
    diff = ds[-1] - x
    kl = -0.5 * (1 + logvar - mean**2 - np.exp(logvar)).sum(axis=1)
    loss = float((w * ((diff**2).mean(axis=1) + net.kl_weight * kl)).sum())
    gd, gz = _backward(ds, dec, 2.0 * diff * w[:, None] / d)
    gm = gz + net.kl_weight * w[:, None] * mean
    gv = gz * noise * 0.5 * sd + net.kl_weight * w[:, None] * 0.5 * (np.exp(logvar) - 1.0)
    ge, _ = _backward(es, enc, np.concatenate([gm, gv], axis=1))
    return loss, np.concatenate([ge, gd])


def _noise(pid: np.ndarray, width: int, seed: int, r: int) -> np.ndarray:
    """Standard normal numbers that depend on key, round and place only."""

    def uniform(salt):
        with np.errstate(over="ignore"):
            z = pid.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(salt, salt + width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed * 1_000_003 + r)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z ^= z >> np.uint64(31)
        return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53

    return np.sqrt(-2.0 * np.log(uniform(1))) * np.cos(2.0 * np.pi * uniform(1 + width))


def _weights_only(net: Net) -> np.ndarray:
    """1 for weights, 0 for biases."""
    return np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in [*net.encoder, *net.decoder]])


def _train(points: DataFrame, net: Net, rounds: int, lr: float, seed: int, tol: float, alpha: float) -> Net:
    size = len(net.theta)
    n = points.count()
    batches = max(1, min(BATCHES, n // 32))
    at = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(batches))
    parts = [cut_lineage(points.filter(at == i)) for i in range(batches)] if batches > 1 else [points]
    penalty = alpha / PENALTY_ROWS * _weights_only(net)
    m1, m2, t, stale = np.zeros(size), np.zeros(size), 0, 0
    for r in range(rounds):
        loss = rows = 0.0
        for i in np.random.default_rng([seed, r]).permutation(batches):

            def sums(b, theta=net.theta, r=r):
                x, w = coordinates(b), b["w"].to_numpy(dtype=float)
                noise = _noise(b["pid"].to_numpy(), net.latent, seed, r) if net.kl_weight is not None else None
                part, g = _loss(net, theta, x, w, noise)
                return np.concatenate([g, [part, w.sum()]])

            out = summed(parts[i], sums, size + 2)
            if not out[-1]:
                continue
            loss, rows = loss + out[-2], rows + out[-1]
            g = out[:size] / out[-1] + penalty * net.theta
            t += 1
            m1 = 0.9 * m1 + 0.1 * g
            m2 = 0.999 * m2 + 0.001 * g * g
            net.theta = net.theta - lr * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        if not rows:
            break
        net.history.append(loss / rows)
        if r and net.history[-2] - net.history[-1] < tol * max(1e-12, abs(net.history[-2])):
            stale += 1
            if stale >= 3:
                break
        else:
            stale = 0
    return net


def _fit(df, cols, id_col, latent, hidden, rounds, lr, seed, tol, alpha, kl_weight, points=None) -> Net:
    cols, d = list(cols), len(cols)
    encoder = _shapes([d, *hidden, latent * (1 if kl_weight is None else 2)])
    decoder = _shapes([latent, *reversed(hidden), d])
    theta = _init([*encoder, *decoder], np.random.default_rng(seed))
    points = training_points(df, cols, id_col) if points is None else points
    return _train(points, Net(cols, encoder, decoder, theta, latent, kl_weight), rounds, lr, seed, tol, alpha)


def autoencoder_fit(
    df: DataFrame, cols: Sequence[str], id_col: str, latent: int = 10, hidden: Sequence[int] = (32,), rounds: int = 20, lr: float = 0.01, seed: int = 42,
    tol: float = 1e-4, alpha: float = 1e-4,
) -> Net:
    """Dense net with squared loss and the weight penalty ``alpha``; stops after three rounds that gain less than ``tol``."""
    return _fit(df, cols, id_col, latent, hidden, rounds, lr, seed, tol, alpha, None)


def vae_fit(
    df: DataFrame, cols: Sequence[str], id_col: str, latent: int = 4, hidden: Sequence[int] = (32,), kl_weight: float = 0.05, rounds: int = 20,
    lr: float = 0.01, seed: int = 42, tol: float = 1e-4, alpha: float = 1e-4,
) -> Net:
    """Reparameterized variational autoencoder: loss = reconstruction + kl_weight * KL (+ the weight penalty)."""
    return _fit(df, cols, id_col, latent, hidden, rounds, lr, seed, tol, alpha, kl_weight)


_OUT = T.StructType(
    [
        T.StructField("latent", T.ArrayType(T.DoubleType())),
        T.StructField("logvar", T.ArrayType(T.DoubleType())),
        T.StructField("hat", T.ArrayType(T.DoubleType())),
        T.StructField("err", T.DoubleType()),
    ]
)


def net_apply(df: DataFrame, net: Net, out: str = "_net") -> DataFrame:
    """Struct column: latent code (mean), log-variance, reconstruction, mean squared error."""

    @F.pandas_udf(_OUT)
    def run(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"latent": [], "logvar": [], "hat": [], "err": []})
        block = np.stack(x.to_numpy())
        enc, dec = net.parts()
        code = _forward(block, enc)[-1]
        mean = code[:, : net.latent]
        logvar = np.clip(code[:, net.latent :], -10.0, 10.0) if net.kl_weight is not None else np.zeros((len(block), 0))
        hat = _forward(mean, dec)[-1]
        return pd.DataFrame({"latent": list(mean), "logvar": list(logvar), "hat": list(hat), "err": ((hat - block) ** 2).mean(axis=1)})

    return df.withColumn(out, run(point(net.cols)))


def autoencoder_score(df: DataFrame, net: Net, out: str = "reconstruction_error", codes: bool = False) -> DataFrame:
    applied = net_apply(df, net)
    cols = {out: F.col("_net.err")}
    if codes:
        cols |= {f"latent_{i + 1}": F.get("_net.latent", F.lit(i)) for i in range(net.latent)}
    return applied.withColumns(cols).drop("_net")


def vae_score(df: DataFrame, net: Net, codes: bool = False) -> DataFrame:
    """``reconstruction_error, kl_divergence, total_loss, latent_variance_mean`` (and latent means)."""
    from oddrows.functions.columns import kl_gauss

    applied = net_apply(df, net)
    var = F.transform("_net.logvar", lambda v: F.exp(v))
    cols = {
        "reconstruction_error": F.col("_net.err"),
        "kl_divergence": kl_gauss(F.col("_net.latent"), F.col("_net.logvar")),
        "latent_variance_mean": F.aggregate(var, F.lit(0.0), lambda s, v: s + v) / net.latent,
    }
    if codes:
        cols |= {f"latent_{i + 1}": F.get("_net.latent", F.lit(i)) for i in range(net.latent)}
    out = applied.withColumns(cols).drop("_net")
    return out.withColumn("total_loss", F.col("reconstruction_error") + F.lit(net.kl_weight) * F.col("kl_divergence"))


def generate(spark: SparkSession, net: Net, n: int, seed: int = 42) -> DataFrame:
    """n synthetic rows: standard normal codes through the decoder."""
    codes = spark.range(n).select("id", F.array(*[F.randn(seed + i) for i in range(net.latent)]).alias("z"))
    cols = net.cols

    def decode(batches):
        _, dec = net.parts()
        for b in batches:
            if len(b):
                hat = _forward(np.stack(b["z"].to_numpy()), dec)[-1]
                yield pd.DataFrame({"id": b["id"].to_numpy(), **{c: hat[:, j] for j, c in enumerate(cols)}})

    return codes.mapInPandas(decode, "id long, " + ", ".join(f"`{c}` double" for c in cols))


def fit_with_validation(df: DataFrame, cols: Sequence[str], id_col: str, fit, test_frac: float = 0.2, seed: int = 42, **kw):
    """Hold out a seeded share, fit on the rest: ``(net, frame with training and validation error)``."""
    parts = cut_lineage(train_test(df.select(id_col, *cols), id_col, test_frac, seed=seed))
    net = fit(parts.filter("part = 'train'"), cols, id_col, seed=seed, **kw)
    scored = net_apply(parts, net).select("part", F.col("_net.err").alias("err"))
    return net, scored.groupBy("part").agg(F.avg("err").alias("mse"), F.count("*").alias("n"))


def net_params(net: Net) -> dict[str, np.ndarray]:
    """Parameters by layer, for :func:`oddrows.models.common.save_model`."""
    enc, dec = net.parts()
    out = {}
    for name, layers in (("encoder", enc), ("decoder", dec)):
        for i, (w, b) in enumerate(layers):
            out[f"{name}_{i}_weight"], out[f"{name}_{i}_bias"] = w, b
    return out


def net_from_params(cols: Sequence[str], params: dict[str, np.ndarray], kl_weight: float | None = None) -> Net:
    shapes, theta = {"encoder": [], "decoder": []}, []
    for name in ("encoder", "decoder"):
        i = 0
        while f"{name}_{i}_weight" in params:
            w, b = params[f"{name}_{i}_weight"], params[f"{name}_{i}_bias"]
            shapes[name].append(w.shape)
            theta += [w.ravel(), b]
            i += 1
    return Net(list(cols), shapes["encoder"], shapes["decoder"], np.concatenate(theta), shapes["decoder"][0][0], kl_weight)
