"""Quality by a sparse rule ensemble over statistics of the text.

Small trees on random halves of a labelled sample give conjunctive rules (the path to each node); a lasso logistic fit keeps
the few that matter; those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import with_arrow
from oddrows.llm.lasso import fit_lasso

STATISTICS = (
    "log_chars log_words word_length long_words distinct_words repeated_next repeated_pairs repeated_lines line_words "
    "letters upper digits marks symbols capital_words short_words edge_symbols"
).split()

# Kinds of sign below code point 256: other, lower, upper, digit, white space, common mark.
_KIND = np.zeros(256, np.int64)
for _code in range(256):
    _sign = chr(_code)
    _KIND[_code] = 2 if _sign.isupper() else 1 if _sign.isalpha() else 3 if _sign.isdecimal() else 4 if _sign.isspace() else 5 if _sign in ".,;:'\"!?-()" else 0


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text; of a null or empty text, all 0."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = codes[codes < 256]
    kinds = np.bincount(_KIND[low], minlength=6).tolist()
    n, m = len(codes), len(words)
    visible = max(1, n - kinds[4])
    lengths = np.fromiter(map(len, words), np.int64, m)
    lines = [s for s in text.split("\n") if s]
    pairs = max(1, m - 1)
    # signs above the Latin block count as letters
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(lengths.mean()),
        float((lengths > 20).mean()),
        len(set(words)) / m,
        sum(map(str.__eq__, words, words[1:])) / pairs,
        1 - len(set(zip(words, words[1:]))) / pairs if m > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        m / len(lines),
        (kinds[1] + kinds[2] + n - len(low)) / visible,
        kinds[2] / visible,
        kinds[3] / visible,
        kinds[5] / visible,
        kinds[0] / visible,
        sum(map(str.isupper, words)) / m,
        float((lengths < 4).mean()),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / m,
    ]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of the whole text as double columns."""
    schema = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    return with_arrow(df, [text], schema, lambda: lambda texts: list(zip(*[statistics_of(t) for t in texts])))


# One condition of a rule: statistic, cut, and whether the value lies above it.
Condition = tuple[str, float, bool]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = reduce(Column.__and__, [F.col(s) > cut if above else F.col(s) <= cut for s, cut, above in conditions])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Paths to all nodes of a tree grown by the largest fall of the Gini impurity."""
    found = [path] if path else []
    n, ones = len(y), y.sum()
    if depth == 0 or n < 20 or ones in (0, n):
        return found
    best = (1e-9, None, None)
    for k, cut in enumerate(cuts):
        at = np.searchsorted(cut, x[:, k], side="left")  # at <= j: value <= cut[j]
        left_n = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
        left_1 = np.cumsum(np.bincount(at, weights=y, minlength=len(cut) + 1))[:-1]
        right_n, right_1 = n - left_n, ones - left_1
        ok = (left_n >= 5) & (right_n >= 5)
        gain = np.where(ok, left_1**2 / np.maximum(left_n, 1) + right_1**2 / np.maximum(right_n, 1) - ones**2 / n, 0)
        if len(gain) and gain.max() > best[0]:
            j = int(gain.argmax())
            best = (float(gain[j]), k, float(cut[j]))
    _, k, cut = best
    if k is None:
        return found
    above = x[:, k] > cut
    for side in (False, True):
        rows = above == side
        found += _paths(x[rows], y[rows], names, cuts, depth - 1, (*path, (names[k], cut, side)))
    return found


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 1e-3, seed: int = 1) -> RuleModel:
    """Rules from ``trees`` trees, each on half of the rows and half of the statistics, weighted by a lasso logistic fit."""
    draw = np.random.default_rng(seed)
    rules: dict[tuple[Condition, ...], None] = {}
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 99))) for k in range(len(names))]
        for _ in range(trees):
            rows = draw.random(len(y)) < 0.5
            some = np.sort(draw.choice(len(names), (len(names) + 1) // 2, replace=False))
            for path in _paths(x[rows][:, some], y[rows], [names[k] for k in some], [cuts[k] for k in some], depth):
                rules[tuple(sorted(path))] = None
    place = {s: k for k, s in enumerate(names)}
    holds = [np.logical_and.reduce([(x[:, place[s]] > cut) == above for s, cut, above in rule]) for rule in rules]
    matrix = np.array(holds, np.float32).T if holds else np.zeros((len(y), 0), np.float32)
    intercept, weights = fit_lasso(matrix, y, penalty)
    return RuleModel(intercept, [(rule, float(w)) for rule, w in zip(rules, weights) if w])


def labelled(labels: DataFrame, label: str, held_out: Column, rows: int | None = None) -> DataFrame:
    """Labelled documents outside the held-out fold, or at most ``rows`` of them by the order of a hash: (doc_id, label)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    each = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    return each if rows is None else each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents (the bounded sample goes to the driver as statistics only).

    Of a repeated id the least statistics in order count.
    """
    sample = labelled(labels, label, fold(5, 0), sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    each = with_statistics(chosen).groupBy("doc_id", "label").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    rows = each.select("doc_id", "label", "s.*").orderBy("doc_id").collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([float(r["label"]) for r in rows]), STATISTICS)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Score every whole text, however long. A null text is scored as an empty one, whose statistics are all 0.

    Without labels every score is 1/2; repeated rows are scored alike.
    """
    model = fit_quality(docs, labels)
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", model.score())
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
