"""Benchmark decontamination over templates.

Words become a template: numbers, names (words in title case) and units are typed placeholders, all else is itself in lower
case without marks around it. Windows of ``width`` words meet by the hash of their template; a pair counts when its slots
are consistent: equal values on one side face equal values on the other, type by type. So a question with other numbers or
names is caught, while a chance likeness of placeholders is not. A benchmark window with no more words than placeholders has
no template: it meets by the hash of its lower-case words as they are, so that its verbatim copies are found. Units of one or two
letters are units after a number, else words like others.

A word that stands in no benchmark item cannot be part of a match, so documents are read against a bitmap of the benchmark's words:
only where enough possible words follow each other are windows hashed at all.

An item of fewer words than a window is one window of its own; below ``LEAST`` words it is looked for verbatim only. Null and
empty texts match nothing. Ids keep their type; they may be null.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddrows.llm.common import SLICE_ROWS, mix64, save, unused

WIDTH = 10
# Items of fewer words have no template.
LEAST = 5
# Bits of the bitmap of the benchmark's words, whatever their number: false hits cost time only.
WORD_BITS = 23
# Benchmark windows whose hashes are sent to the tasks at once (8 bytes each); more are taken in blocks.
BLOCK = 1_000_000
MEMORY = 300_000
# Base of the window hashes, its inverse modulo 2^64, and what sets hashes of words apart from those of templates.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
VERBATIM = 0xD1B54A32D192ED03
# Words that count as units.
UNITS = frozenset(
    "% $ € £ ¥ mm cm m km in ft yd mi mile miles metre metres meter meters inch inches foot feet yard yards "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml cl l litre litres liter liters gallon gallons s sec min h hr second seconds minute minutes hour hours "
    "day days week weeks month months year years mph kmh °c °f degree degrees percent "
    "dollar dollars euro euros cent cents w kw kwh v a hz khz mhz ghz kb mb gb tb".split()
)
SIGNS = "$€£¥%"
PART = re.compile(r"[$€£¥%]|[+-]?\d+(?:[.,:/]\d+)*|°?[^\W\d]+(?:[-'’][^\W\d]+)*")
EDGE = "\"'.,;:?!()[]{}<>«»“”‘’*_~`|"
TYPES = ("NUM", "NAME", "UNIT")


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def parts_of(word: str) -> list[tuple[int, int, str, bool]]:
    """(hash, type, value, short) of each part of a word; type -1 is a literal part, a short one is a unit after a number."""
    bare = word.strip(EDGE)
    found = PART.findall(bare) if any(map(str.isdigit, bare)) or any(c in bare for c in SIGNS) else [bare]
    made = []
    for k, part in enumerate(found):
        if not part:
            continue
        low = part.lower()
        # one or two letters set apart can be another word ("in", "a"), so the part before decides
        short = low in UNITS and low not in SIGNS and len(found) == 1 and len(low) <= 2
        if part[-1].isdigit():
            kind = 0
        elif low in UNITS and not short:
            kind = 2
        elif part[0].isupper() and part[1:].islower():
            kind = 1
        else:
            kind = -1
        made.append((word_hash(low if kind < 0 else f"<{TYPES[kind]}>"), kind, low, short))
    return made


NUM, UNIT = (np.uint64(word_hash(f"<{t}>")) for t in ("NUM", "UNIT"))


def literal_bit(part: str) -> int:
    return zlib.crc32(part.encode()) >> (32 - WORD_BITS)


def literal_known(bits: bytes, part: str) -> int:
    at = zlib.crc32(part.encode()) >> (32 - WORD_BITS)
    return bits[at >> 3] >> (at & 7) & 1


# what stands for a literal that is in no benchmark item
NOWHERE = np.uint64(0)


class Templates:
    """Words to hashes of template and word, remembered for up to ``MEMORY`` words.

    With a bitmap of possible literals (by ``literal_bit``), all others are hashed as ``NOWHERE``.
    """

    def __init__(self, possible: bytes | None = None):
        self.known: dict[str, bytes] = {}
        self.possible = possible
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.nowhere, self.name = bytes(16), word_hash("<NAME>").to_bytes(8, "little") + bytes(8)

    def packed(self, word: str) -> bytes:
        """For each part of a word the hash in a template and of the part itself; the lowest bit of the latter marks a short unit."""
        possible = self.possible
        if possible is not None:
            bare = word.strip(EDGE)
            if bare.isalpha():
                # most words are one literal (or name) that no benchmark item holds
                low = bare.lower()
                if low not in UNITS and not literal_known(possible, low):
                    return self.name if bare[0].isupper() and bare[1:].islower() else self.nowhere
        made = []
        for h, kind, low, short in parts_of(word):
            here = possible is None or literal_known(possible, low)
            plain = word_hash(low) & ~1 if here else 0
            made.append((h if here or kind >= 0 else 0).to_bytes(8, "little") + (plain | short).to_bytes(8, "little"))
        return b"".join(made)

    def hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By part: hash in the template with the part before in view, the same without, hash of the lower-case part itself."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.packed(word)
        pairs = np.frombuffer(b"".join(map(known.__getitem__, words)), np.dtype("<u8")).reshape(-1, 2)
        alone, plain = pairs[:, 0], pairs[:, 1]
        inside, short = alone, plain & np.uint64(1)
        if short.any():
            at = np.flatnonzero(short[1:])
            at = at[alone[at] == NUM] + 1
            inside = alone.copy()
            inside[at] = UNIT
        return inside, alone, plain & ~np.uint64(1)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        """Running sums of the hashes, each times the power of its place."""
        if len(self.powers) < len(hashes):
            size = 2 * len(hashes)
            self.powers, self.inverses = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, f, np.uint64))]) for f in (FACTOR, INVERSE))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: len(hashes)], dtype=np.uint64)])

    def windows(self, words: list[str], kinds: list[tuple[int, bool]]) -> Iterator[tuple[int, bool, bool, np.ndarray, np.ndarray]]:
        """For each (width, verbatim) that fits: both, whether the first part is taken alone, places and hashes of the windows.

        A window whose first part is a unit by the number before it has two templates, with that number in view and without, so
        that it also meets a copy that begins there.
        """
        inside, alone, plain = self.hashes(words)
        # a short unit counts as possible by either of its readings
        gaps = {False: (inside == NOWHERE) & (alone == NOWHERE), True: plain == NOWHERE}
        missing = {v: np.concatenate([[0], np.cumsum(gap)]) for v, gap in gaps.items()} if self.possible is not None else {}
        sums: dict[bool, np.ndarray] = {}
        for width, verbatim in kinds:
            n = len(plain) - width + 1
            if n < 1:
                continue
            places = np.flatnonzero(missing[verbatim][width:] == missing[verbatim][:n]) if missing else np.arange(n)
            if not len(places):
                continue
            if verbatim not in sums:
                sums[verbatim] = self.sums(plain if verbatim else inside)
            total = (sums[verbatim][places + width] - sums[verbatim][places]) * self.inverses[places]
            salt = np.uint64(width + VERBATIM * verbatim)
            yield width, verbatim, False, places, mix64(total + salt)
            if not verbatim and inside is not alone:
                odd = np.flatnonzero(inside[places] != alone[places])
                at = places[odd]
                yield width, False, True, at, mix64(total[odd] + alone[at] - inside[at] + salt)


def all_parts(words: list[str]) -> list[tuple[int, int, str]]:
    """(type with the part before in view, type without, value) of each part."""
    made: list[tuple[int, int, str]] = []
    for _, kind, value, short in chain.from_iterable(map(parts_of, words)):
        made.append((2 if short and made and made[-1][0] == 0 else kind, kind, value))
    return made


def slots(parts: list, at: int, width: int, alone: bool) -> list[str]:
    """Values in the placeholders of a window, each after its type."""
    kinds = [parts[at][alone], *[inside for inside, _, _ in parts[at + 1 : at + width]]]
    return [f"{kind}{part[2]}" for kind, part in zip(kinds, parts[at : at + width]) if kind >= 0]


def mostly_literal(parts: list, width: int, alone: bool) -> np.ndarray:
    """Whether each window has more words than placeholders."""
    literal = np.array([[inside < 0, by_itself < 0] for inside, by_itself, _ in parts], np.int64)
    n = len(literal) - width + 1
    total = np.concatenate([[0], np.cumsum(literal[:, 0])])
    return 2 * (total[width:] - total[:n] + alone * (literal[:n, 1] - literal[:n, 0])) > width


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Windows of every item: hash, item_id, width, verbatim, at, slots, of_windows (how many the item has).

    A window is there by its template with the slots, or verbatim without any where placeholders are the most or words are few.
    """
    kind = items.schema["item_id"].dataType
    item_type = to_arrow_schema(T.StructType([T.StructField("item_id", kind)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, text in zip(*[c.to_pylist() for c in batch.columns]):
                words = (text or "").split()
                parts = all_parts(words)
                size = min(width, len(parts))
                for w, verbatim, alone, places, hashes in templates.windows(words, [(size, False), (size, True)] if size else []):
                    wanted = ((size >= LEAST) & mostly_literal(parts, w, alone)[places]) != verbatim
                    for k, h in zip(places[wanted].tolist(), hashes[wanted].astype(np.int64).tolist()):
                        rows.append((h, item, w, verbatim, k, [] if verbatim else slots(parts, k, w, alone), len(parts) - w + 1))
            names = ["hash", "item_id", "width", "verbatim", "at", "slots", "of_windows"]
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), item_type, pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"hash long, item_id {kind.simpleString()}, width int, verbatim boolean, at int, slots array<string>, of_windows int"
    return items.select("item_id", "text").mapInArrow(run, schema)


def possible_literals(items: DataFrame) -> bytes:
    """Bitmap of the literals of all items, of ``2 ** WORD_BITS`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = {literal_bit(low) for text in batch.column(0).to_pylist() for w in set((text or "").split()) for _, _, low, _ in parts_of(w)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(bits), pa.int32())], names=["bit"])

    found = items.select("text").mapInArrow(run, "bit int").distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << WORD_BITS, bool)
    table[found] = True
    return np.packbits(table, bitorder="little").tobytes()


def matching_windows(docs: DataFrame, wanted: np.ndarray, kinds: list[tuple[int, bool]], possible: bytes) -> DataFrame:
    """Windows of the documents whose hash is wanted: hash, key (digest of the text), doc_id, doc_at, doc_slots.

    Equal windows of a document and item slots are one row, so what a popular window sends is bounded by its documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(wanted), possible))
    kind = docs.schema["doc_id"].dataType
    doc_type = to_arrow_schema(T.StructType([T.StructField("doc_id", kind)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits_of_words = shared.value
        templates = Templates(bits_of_words)
        # most windows are ruled out by the first bits of their hash
        bits = max(16, int(len(known)).bit_length() + 5)
        first = np.zeros(1 << bits, bool)
        first[known >> np.uint64(64 - bits)] = True
        types = [pa.int64(), pa.string(), doc_type, pa.int32(), pa.list_(pa.string())]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = []
                for doc, text in zip(*[c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns]):
                    key, words = None, (text or "").split()
                    seen: set = set()
                    for w, verbatim, alone, places, hashes in templates.windows(words, kinds):
                        at = np.flatnonzero(first[hashes >> np.uint64(64 - bits)])
                        if len(at):
                            at = at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]
                        if len(at):
                            if key is None:
                                key, parts = hashlib.md5(text.encode()).hexdigest(), all_parts(words)
                            for k, h in zip(places[at].tolist(), hashes[at].astype(np.int64).tolist()):
                                values = [] if verbatim else slots(parts, k, w, alone)
                                if (h, alone, *values) not in seen:  # places rise, so the first one stays
                                    seen.add((h, alone, *values))
                                    rows.append((h, key, doc, k, values))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["hash", "key", "doc_id", "doc_at", "doc_slots"])

    return docs.select("doc_id", "text").mapInArrow(run, f"hash long, key string, doc_id {kind.simpleString()}, doc_at int, doc_slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Documents that hold a window of a benchmark item, one row per document and item.

    Columns: key (md5 of the text), doc_id, item_id, n_windows (of the item, found with consistent slots), coverage (their
    share), first_at (word), changed (some slot has another value). Rows that repeat an id and a text count once.
    """
    items = save(benchmark_windows(benchmark, width), "benchmark-windows")
    hashes = items.select("hash").distinct()
    kinds = sorted((r["width"], r["verbatim"]) for r in items.select("width", "verbatim").distinct().collect())
    blocks = max(1, -(-hashes.count() // BLOCK))
    possible = possible_literals(benchmark)
    found = None
    for k in range(blocks):
        part = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == k)
        wanted = np.array([r["hash"] for r in part.collect()], np.int64).astype(np.uint64)
        some = matching_windows(docs, wanted, kinds if len(wanted) else [], possible)
        found = some if found is None else found.unionByName(some)
    pairs = F.zip_with("slots", "doc_slots", lambda a, b: F.concat(a, F.lit("\u0000"), b))
    distinct = lambda c: F.size(F.array_distinct(c))
    consistent = (distinct(pairs) == distinct("slots")) & (distinct("slots") == distinct("doc_slots"))
    met = found.join(items, "hash").where((F.size("slots") == F.size("doc_slots")) & consistent)
    changed = F.exists(F.arrays_zip("slots", "doc_slots"), lambda s: s["slots"] != s["doc_slots"])
    windows = met.groupBy("key", "doc_id", "item_id", "at").agg(F.min("doc_at").alias("first_at"), F.min(changed).alias("changed"), F.max("of_windows").alias("of_windows"))
    return windows.groupBy("key", "doc_id", "item_id").agg(
        F.count("*").alias("n_windows"),
        (F.count("*") / F.max("of_windows")).alias("coverage"),
        F.min("first_at").cast("long").alias("first_at"),
        F.max("changed").alias("changed"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that hold a benchmark window; columns and rows are otherwise unchanged."""
    (leak,) = unused(docs, "leak")
    bad = leaks(docs, benchmark, width).select(F.col("key").alias(leak)).distinct()
    return docs.join(bad, F.md5(F.col("text").cast("binary")) == F.col(leak), "left_anti")
