"""Filter interaction audit: what each of five filters removes in every order, with duplicates found in radix tries.

1. Texts are dealt to tasks by adaptive prefixes. A prefix under which more than ``RANGE_BYTES`` of different texts stand is
   replaced by its longer prefixes, level by level, so every leaf prefix is a range of the text order that one trie can hold.
2. Each task first inserts its own texts into a compressed trie and sends every different text once, with its least id: a text
   that a third of all documents share costs one row per task. The texts of a range meet in one trie, whose terminals hold the
   least id of all; a traversal lists them.
3. A document is a duplicate unless it is the least of its text's terminal. With the four tests of single texts that is a mask
   of five bits; masks are counted per part, and all orders of the filters are read off the at most 32 counts.

Of the prefixes only the 64-bit hashes of those that were replaced are broadcast: 8 bytes for each ``RANGE_BYTES`` of text and
level, and never more than ``MOST_RANGES`` a level, as ranges grow beyond that.

Null texts are empty, a null part is the empty string. A row without an id is never a duplicate and makes none; rows that repeat
an id and a text are no duplicates of each other. Repeated labels of an id count as 1 if any is 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import with_arrow

FILTERS = "ABCDE"
# Bytes of text under one prefix before it is replaced by longer ones, and bytes that a task's own trie may hold.
RANGE_BYTES, LOCAL_BYTES = 2 << 20, 16 << 20
MOST_RANGES = 1_000_000
# Signs of the first prefix; each level has four times as many as the one before.
FIRST_PREFIX, GROWTH = 16, 4
# Prefixes of a text beside the first; the last holds 2^28 signs.
MOST_LEVELS = 12

_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_MARKS = re.compile(rb"[#$%&*|]")


def text_fails(data: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = data.split()  # of bytes: at the signs 20 and 09 to 0D only
    signs = len(data) - len(data.translate(None, bytes(range(128, 192)))) if not data.isascii() else 0
    capitals = len(data.translate(None, _NOT_CAPITALS))
    few = len(words) < 200
    repeated = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * capitals > 2 * (len(data) - signs)
    return few | repeated << 1 | loud << 2 | bool(_MARKS.search(data)) << 3


class Trie:
    """Compressed trie of byte strings. A node is [label, children by first byte, value]; only terminals have a value."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.size = 0

    def insert(self, text: bytes, least: int | None, mark: int) -> None:
        """Add a text with an id; its terminal keeps the least one, and ``mark``, which is the same for equal texts."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                self.size += end - at + 1
                node = child
                break
            label = child[0]
            if not text.startswith(label, at):
                common = shared(label, text, at)
                upper = node[1][text[at]] = [label[:common], {label[common]: child}, None]
                child[0] = label[common:]
                child = upper
            node, at = child, at + len(child[0])
        held = node[2]
        if held is None:
            node[2] = (least, mark)
            self.size += 1
        elif held[0] is None or (least is not None and least < held[0]):
            node[2] = (least, held[1])

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every text with its least id and mark, in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            text = above + node[0]
            if node[2] is not None:
                yield (text, *node[2])
            stack += [(text, node[1][b]) for b in sorted(node[1], reverse=True)]


def shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of a label and of the text from a place on (they differ somewhere)."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def prefix_hashes(first: int = FIRST_PREFIX) -> Column:
    """Hashes of the prefixes of ``text``, each ``GROWTH`` times as long as the one before, up to the first that holds all of it."""

    def depth(level: Column) -> Column:
        return F.pow(F.lit(GROWTH), level).cast("int") * first

    needed = F.filter(F.sequence(F.lit(0), F.lit(MOST_LEVELS)), lambda k: (k == 0) | (F.length("text") > depth(k - 1)))
    return F.transform(needed, lambda k: F.xxhash64(k, F.substring(F.col("text"), F.lit(1), depth(k))))


def with_range(texts: DataFrame, range_bytes: int = RANGE_BYTES, first: int = FIRST_PREFIX) -> DataFrame:
    """Add ``range``, the hash of the leaf prefix of ``text``, to rows with ``text`` and ``mark`` (a hash of the whole text).

    A prefix that holds only copies of one text, or only texts that end there, is a leaf whatever its size. All levels are counted
    at once, as what a longer prefix holds the shorter one holds too; a text's range is the first prefix that is not replaced.
    """
    size = F.octet_length("text").cast("long")
    total = texts.agg(F.sum(size)).first()[0] or 0
    limit = max(range_bytes, total // MOST_RANGES)
    levels = prefix_hashes(first)
    # a text does not go on behind its last prefix
    inside = texts.select(levels.alias("levels"), size.alias("size"), "mark")
    inside = inside.select(F.explode(F.slice("levels", F.lit(1), F.size("levels") - 1)).alias("range"), "size", "mark")
    heavy = inside.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("mark").alias("low"), F.max("mark").alias("high"))
    heavy = heavy.where((F.col("bytes") > limit) & (F.col("low") != F.col("high"))).select("range")
    replaced = texts.sparkSession.sparkContext.broadcast({r["range"] for r in heavy.collect()})  # at most total / limit hashes a level

    @F.pandas_udf("long")
    def leaf(found: pd.Series) -> pd.Series:
        gone = replaced.value
        return pd.Series([next((h for h in hashes.tolist() if h not in gone), hashes[-1]) for hashes in found], dtype="int64")

    return texts.withColumn("range", leaf(levels))


def first_documents(texts: DataFrame, range_bytes: int = RANGE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """The least id of each different text: least, mark. Rows have doc_id, text and mark."""
    schema = "range long, text binary, least long, mark long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Trie] = {}
        held = 0

        def sent():
            rows = [(r, *t) for r, trie in tries.items() for t in trie.terminals()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

        names, types = ["range", "text", "least", "mark"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            for place, text, least, mark in zip(*[c.to_pylist() for c in batch.columns]):
                trie = tries.get(place)
                if trie is None:
                    trie = tries[place] = Trie()
                before = trie.size
                trie.insert(text, least, mark)
                held += trie.size - before
                if held > local_bytes:
                    yield sent()
                    tries, held = {}, 0
        if tries:
            yield sent()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = Trie(), None

        def listed():
            ends = [(least, mark) for _, least, mark in trie.terminals()]
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())], names=["least", "mark"])

        for batch in batches:
            for place, text, least, mark in zip(*[c.to_pylist() for c in batch.columns]):
                # small ranges share a trie; a new range never adds to a full one
                if place != last and trie.size > local_bytes:
                    yield listed()
                    trie = Trie()
                last = place
                trie.insert(text, least, mark)
        yield listed()

    ranged = with_range(texts, range_bytes).select("range", F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("least"), "mark")
    dealt = ranged.mapInArrow(local, schema).repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(meet, "least long, mark long").where("least IS NOT NULL")


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """Per document: doc_id, part and ``fails``, the bits of the filters that it fails (A is 1, E is 16)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    given = given.withColumn("mark", F.xxhash64("text"))

    def make():
        def rows(data):
            return [[text_fails(d) for d in data]]

        return rows

    single = with_arrow(given.withColumn("text", F.col("text").cast("binary")), ["text"], T.StructType([T.StructField("fails", T.IntegerType())]), make)
    single = single.select("doc_id", "part", "mark", "fails")
    first = first_documents(given).select(F.col("least").alias("doc_id"), "mark", F.lit(True).alias("first"))
    repeated = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), 16).otherwise(0)
    return single.join(first, ["doc_id", "mark"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(repeated).alias("fails"))


def _summed(count: str, test) -> Column:
    """Sum of a count over the masks that pass a test."""
    return F.aggregate("masks", F.lit(0).cast("long"), lambda total, m: total + F.when(test(m["fails"]), m[count]).otherwise(0))


def interactions(fails: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the masks of ``failed_filters`` and 0/1 labels by doc_id."""
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counted = fails.join(marks, "doc_id", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = F.struct("fails", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    parts = counted.groupBy("part").agg(F.collect_list(counts).alias("masks"))  # 32 at most
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", place, F.lit(1))) - ord(FILTERS[0]))

    earlier = F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(1), F.col("step") - 1), F.lit(0), lambda bits, k: bits.bitwiseOR(bit(k)))
    placed = steps.withColumn("own", bit(F.col("step"))).withColumn("earlier", earlier)
    own, gone = F.col("own"), F.col("earlier")

    def here(m):
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(gone) == 0)

    # a document that fails k filters is removed by each of them in 120 / k of the orders
    total = len(list(permutations(FILTERS)))
    shapley = F.aggregate(
        "masks",
        F.lit(0).cast("long"),
        lambda s, m: s + F.when(m["fails"].bitwiseAND(own) != 0, m["n"] * (F.lit(total) / F.bit_count(m["fails"])).cast("long")).otherwise(0),
    )
    return placed.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        _summed("n", lambda m: m.bitwiseAND(own.bitwiseOR(gone)) == 0).alias("kept"),
        _summed("n", here).alias("removed"),
        _summed("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        _summed("n", lambda m: m == own).alias("unique_fails"),
        _summed("good", here).alias("good_lost"),
        _summed("toxic", here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each filter removes within each part, for all orders of the filters."""
    return interactions(failed_filters(docs, part), labels)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS fails
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT x1.letter || x2.letter || x3.letter || x4.letter || x5.letter AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
  FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.bit + x2.bit + x3.bit + x4.bit + x5.bit = 31 AND len(list_distinct([x1.bit, x2.bit, x3.bit, x4.bit, x5.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM o, range(1, 6) r(step)),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (fails & (own | gone) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (fails & own <> 0 AND fails & gone = 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & own <> 0 AND fails & gone <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & own <> 0 AND fails & gone = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & gone = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
