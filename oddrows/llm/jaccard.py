"""Jaccard join of word n-grams with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Equal texts are one class from the start. MinHash bands propose candidates: texts that
share a bucket are tied to the bucket's first, never listed in pairs, and what hangs together is one candidate set. Sets are
cut into chunks of bounded size, and a task holds two chunks at most. Inside, MinHash values are compared a few at a time; a
pair goes as soon as the posterior probability that it reaches the threshold, given the matches so far, falls below
``TOLERANCE``. What is left is verified on the whole shingle sets. Tasks report link counts and a spanning star, not pairs.

With 24 bands of 4 values, a pair at a similarity of exactly 0.8 shares no bucket with a probability of 3e-6, and is pruned
with one of about 1e-6; both fall steeply above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import components, groups, mix64, save, unused, with_arrow

WIDTH, THRESHOLD = 5, 0.8
BANDS, VALUES = 24, 4
HASHES = BANDS * VALUES
# MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
# Shingles of the texts of one chunk; a text counts as LEAST of them or more, which bounds their number.
CHUNK, LEAST = 500_000, 250
MEMORY = 300_000
HAS_WORDS = r"[^ \t\n\r\f\x0B]"

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**64, HASHES, dtype=np.uint64)


class Shingles:
    """Distinct shingle hashes of a text, remembering the hashes of up to ``MEMORY`` words.

    Words are what ASCII white space separates, as they are. A text of fewer than ``WIDTH`` words is one shingle.
    """

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        known, words = self.known, (text or "").encode().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > MEMORY:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = mix64(total + hashes[k : k + n])
        return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), 512):
        some = (shingles[start : start + 512, None] * _FACTORS + _SHIFTS) >> np.uint64(32)
        least = np.minimum(least, some.min(0).astype(np.uint32))
    return least


def matches_needed() -> list[int]:
    """For each number of values compared, the fewest matches with which a pair stays.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), whose tail above the threshold t is
    the probability of at most m successes in n + 1 draws at t.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < TOLERANCE:
            m += 1
            tail += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        needed.append(m)
    return needed


NEEDED = matches_needed()


def survivors(left: np.ndarray, right: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which of the allowed (left, right) pairs of signatures outlive every round, as a matrix."""
    x, y = allowed.nonzero()
    count = np.zeros(len(x), np.int16)
    for k, need in enumerate(NEEDED):
        some = slice(k * STEP, (k + 1) * STEP)
        count += (left[x, some] == right[y, some]).sum(1, dtype=np.int16)
        stay = count >= need
        x, y, count = x[stay], y[stay], count[stay]
    alive = np.zeros(allowed.shape, bool)
    alive[x, y] = True
    return alive


def intersections(some: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Shared shingles of one set with each of ``n`` others, from their sorted values and owners."""
    low, high = np.searchsorted(values, some, "left"), np.searchsorted(values, some, "right")
    sizes = high - low
    places = np.arange(sizes.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.bincount(owner[places], minlength=n)


def linked(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray, cross: bool, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the texts of a task: for each, how many documents it links to, and the label of its connected part.

    With ``cross`` only pairs of texts on different sides count, the others being the business of another task.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    links, label = np.zeros(m, np.int64), np.arange(m)
    block = max(1, 200_000 // m)
    for start in range(0, m, block):
        rows = np.arange(start, min(m, start + block))
        allowed = rows[:, None] < np.arange(m)[None, :]
        if cross:
            allowed &= side[rows][:, None] != side[None, :]
        # a set more than 1 / 0.8 times as large as another cannot reach the threshold with it
        small, large = np.minimum(sizes[rows][:, None], sizes), np.maximum(sizes[rows][:, None], sizes)
        alive = survivors(signatures[rows], signatures, allowed & (small >= THRESHOLD * large - 1e-9))
        for x, those in zip(rows.tolist(), alive):
            if not those.any():
                continue
            shared = intersections(sets[x], values, owner, m)
            hits = np.flatnonzero(those & (shared >= THRESHOLD * (sizes[x] + sizes - shared) - 1e-9))
            if len(hits):
                links[x] += copies[hits].sum()
                links[hits] += copies[x]
                labels = np.unique(np.append(label[hits], label[x]))
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]
    return links, label


def jaccard_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per text with words that has a copy or a link: key, first_id, copies, n_links, root_key, group_id.

    ``key`` is the md5 of the text; ``root_key`` marks the text whose first document (``first_id``, ties by key) stays of the
    group; ``group_id`` is that document's id. ``n_links`` counts the other documents linked to one of this text, copies
    included. Texts without words link with nothing. A null id is a document like any other, and comes last.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").rlike(HAS_WORDS))
    keyed = plain.withColumn("key", F.md5(F.col("text").cast("binary")))

    def make():
        shingles = Shingles()

        def rows(texts):
            found = [shingles.of(t) for t in texts]
            return [[len(s) for s in found], [signature(s).tobytes() for s in found]]

        return rows

    new = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("signature", T.BinaryType())])
    signed = with_arrow(keyed, ["text"], new, make).drop("text")
    texts = save(
        signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")),
        "signatures",
    ).withColumn("id", F.xxhash64("key"))

    # candidate sets: every text of a bucket is tied to the bucket's first
    band = [F.xxhash64(F.lit(k), F.substring("signature", 4 * VALUES * k + 1, 4 * VALUES)) for k in range(BANDS)]
    buckets = texts.select("id", F.explode(F.array(*band)).alias("bucket"))
    firsts = buckets.groupBy("bucket").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = buckets.join(firsts, "bucket").select(F.col("id").alias("a"), "b")
    tied = components(ties)
    sets = tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("set"))

    # chunks of a set, and each pair of chunks a task
    weight = F.greatest("size", F.lit(LEAST)).cast("long")
    members = texts.join(sets, "id")
    chunks = members.groupBy("set").agg(F.ceil(F.sum(weight) / CHUNK).cast("int").alias("chunks"))
    placed = members.join(chunks, "set").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(1)), "chunks").cast("int"))
    content = keyed.join(placed.withColumnRenamed("first_id", "doc_id2").withColumnRenamed("key", "key2"), F.expr("key = key2 AND doc_id <=> doc_id2"))
    spread = content.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tasks = spread.select("set", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "copies", "signature", "text")
    tasks = tasks.repartition("set", "i", "j").sortWithinPartitions("set", "i", "j", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for run in groups(batches, 3):
            # repeated rows of one document arrive more than once
            rows = list({r[4]: r for r in run}.values())
            if len(rows) < 2:
                continue
            _, i, j = rows[0][:3]
            sides = np.array([r[3] for r in rows])
            copies = np.array([r[5] for r in rows])
            signatures = np.array([np.frombuffer(r[6], np.uint32) for r in rows])
            links, label = linked([shingles.of(r[7]) for r in rows], signatures, sides, i != j, copies)
            at = links.nonzero()[0]
            if len(at):
                keys = [r[4] for r in rows]
                yield pa.RecordBatch.from_pydict({"key": [keys[k] for k in at], "links": links[at], "tie": [keys[label[k]] for k in at]})

    links = save(tasks.mapInArrow(verify, "key string, links long, tie string"), "links")
    joined = components(links.select(F.col("key").alias("a"), F.col("tie").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    small = texts.select("key", "first_id", "copies")
    rich = small.join(counts, "key", "left").where("links IS NOT NULL OR copies > 1").join(joined, F.col("key") == F.col("node"), "left")
    rich = rich.select("key", "first_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("part"))
    heads = rich.groupBy("part").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("head"))
    return rich.join(heads, "part").select("key", "first_id", "copies", "n_links", F.col("head.key").alias("root_key"), F.col("head.first_id").alias("group_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_links, group_id (the least id that links reach), kept (it is that one).

    Documents without links, and those without words, are groups of their own.
    """
    found = jaccard_groups(docs).select("key", "n_links", "group_id", F.lit(True).alias("grouped"))
    # an equal key of a text without words is not a copy
    keyed = docs.select("doc_id", F.when(F.col("text").rlike(HAS_WORDS), F.md5(F.col("text").cast("binary"))).alias("key"))
    out = keyed.join(found, "key", "left").withColumn("group_id", F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group; columns are unchanged. Rows without words, or without copy or link, all stay."""
    key, first, root, own = unused(docs, "key", "first", "root", "own")
    found = jaccard_groups(docs).select(F.col("key").alias(key), F.col("first_id").alias(first), F.col("root_key").alias(root))
    text = F.col("text")
    joined = docs.withColumn(own, F.when(text.rlike(HAS_WORDS), F.md5(text.cast("binary")))).join(found, F.col(own) == F.col(key), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a row repeated in full is one row
    heads = joined.where((F.col(root) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(first))).dropDuplicates([key]).select(*columns)
    return joined.where(F.col(key).isNull()).select(*columns).unionByName(heads)


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT text, min(doc_id) AS id, count(*) AS copies FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\x0B]') GROUP BY text),
words AS (SELECT id, copies, [x FOR x IN string_split_regex(text, '[ \t\n\r\f\x0B]+') IF x <> ''] AS w FROM texts),
shingles AS (
  SELECT DISTINCT id, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM words)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.id = x JOIN sizes q ON q.id = y WHERE shared.n * 10 >= 8 * (p.n + q.n - shared.n)),
reach(x, y) AS (SELECT id, id FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
heads AS (SELECT x, min(y) AS head FROM reach GROUP BY x),
counted AS (SELECT x, sum(copies) AS links FROM links JOIN texts ON texts.id = y GROUP BY x)
SELECT d.doc_id, CAST(coalesce(t.copies - 1, 0) + coalesce(c.links, 0) AS BIGINT) AS n_links, coalesce(h.head, d.doc_id) AS group_id,
  d.doc_id = coalesce(h.head, d.doc_id) AS kept
FROM documents d LEFT JOIN texts t ON t.text = d.text LEFT JOIN heads h ON h.x = t.id LEFT JOIN counted c ON c.x = t.id
"""
