"""Column expressions shared by the operators; all run inside whole-stage codegen or as native functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the log domain.
SYSTEM_IDS = (0, 1, 2)
FIRST_REAL_USER = 1000
DEFAULT_MOUNT_NAMESPACE = 4026531840
COMMON_PROCESSES = ("bash", "ssh", "systemd", "ls", "cat")
INTERACTIVE_PROCESSES = ("sudo", "su", "bash")
SUSPICIOUS_PATTERN = "tmp|shm|var/tmp|passwd|shadow|etc|bash|curl|wget"

ARGS_TYPE = "array<struct<name:string,type:string,value:string>>"


def clean_number(c: Column) -> Column:
    """Null for null, NaN and the infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == math.inf), None).otherwise(d)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def class3(evil: str = "evil", sus: str = "sus") -> Column:
    return (
        F.when(F.col(evil) == 1, "malicious")
        .when((F.col(evil) == 0) & (F.col(sus) == 1), "suspicious")
        .when((F.col(evil) == 0) & (F.col(sus) == 0), "benign")
    )


def seeded_key(seed: int, *ids: str) -> Column:
    """Text key whose order is a seeded shuffle of the rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def seeded_number(seed: int, *ids: str) -> Column:
    """First 52 bits of :func:`seeded_key` as a number (same order, exact as a double)."""
    return F.conv(F.substring(seeded_key(seed, *ids), 1, 13), 16, 10).cast("long")


def squared_error(xs: Sequence[Column], hats: Sequence[Column], mean: bool = False) -> Column:
    parts = [(x - h) * (x - h) for x, h in zip(xs, hats)]
    return total(parts) / len(parts) if mean else total(parts)


def squared_error_arrays(x: Column, hat: Column, mean: bool = False) -> Column:
    sq = F.aggregate(F.zip_with(x, hat, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return sq / F.size(x) if mean else sq


def kl_gauss(mean: Column, logvar: Column) -> Column:
    """Divergence of N(mean, exp(logvar)) from the standard normal, summed over latent axes."""
    terms = F.zip_with(mean, logvar, lambda m, v: 1 + v - m * m - F.exp(v))
    return F.lit(-0.5) * F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def distance_to(xs: Sequence[str], center: Sequence[float]) -> Column:
    return F.sqrt(total([(F.col(x) - F.lit(float(c))) * (F.col(x) - F.lit(float(c))) for x, c in zip(xs, center)]))


def center_distances_array(xs: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Array of Euclidean distances to literal centres (few centres, bounded)."""
    return F.array(*[distance_to(xs, c) for c in centers])


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where undefined."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def leading(tests: Sequence[Column], values: Sequence[Column] | None = None) -> Column:
    """How many of the first tests hold (or the value at that place), where each test that holds implies those before it.

    A binary search in generated code; a test that is null does not hold.
    """
    values = values or [F.lit(i) for i in range(len(tests) + 1)]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return values[lo]
        mid = (lo + hi) // 2
        return F.when(tests[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(tests))
