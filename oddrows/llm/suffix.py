"""Removal of long repeated strings by longest-previous-factor arrays over suffix order.

A byte goes when a string of ``length`` bytes that covers it also starts elsewhere. Only suffixes whose first ``length`` bytes
recur matter, so suffixes are brought into order up to that depth, in buckets that a Spark shuffle makes:

1. Each text is cut into runs of starts by the least hash of a ``GRAM``-byte string inside the window of ``length`` bytes that
   begins there. Equal windows have equal least hashes, wherever they are, so they meet in one bucket. Runs whose hash
   stands nowhere else are done.
2. The bytes of the other runs go to their bucket. A task takes whole buckets until it holds ``BATCH`` starts, drops what has no
   repeated fingerprint of a window, ranks the suffixes of the rest by doubling from ``COARSE`` bytes up to the depth, and reads the
   longest previous factor of each start off its neighbours in suffix order: the nearest one before and the nearest one after it
   that stand earlier in the corpus. (The order of suffixes that differ within ``COARSE`` bytes is that of their fingerprints, not of
   their bytes; it has no bearing on factors of ``length``.)
3. With ``keep_first`` a start counts if its longest previous factor reaches ``length``, so later copies go and the first stays;
   otherwise also if it is the earlier match of such a start.

Texts that are equal as a whole are worked on once. A bucket above ``CHUNK`` starts, as a passage in a large share of all texts
makes, fits no task: its windows are dealt by fingerprint. Tasks count the fingerprints of what they hold and keep first places, so a
window of all texts is one entry a task; the counts of a part are merged and joined back to its windows, which are dealt over
several tasks where they are many. Two different windows share a fingerprint of 64 bits with a probability of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from oddrows.llm.common import groups, mix64, save, unused, with_arrow

LENGTH, GRAM = 400, 64
# Starts of a text that are hashed at a time, and starts that one task of a bucket holds.
BLOCK, CHUNK = 1 << 16, 100_000
# Starts of small buckets that are ranked together, and width of the strings from whose fingerprints the doubling sets out.
BATCH, COARSE = 100_000, 64

_draw = np.random.default_rng(11)
_BYTE = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    factors = np.full(BLOCK + 4096, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


# block bytes are weighted by rising powers; falling ones bring the hash of a string back to its own place
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def rolling(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, the hash of every string of so many bytes in a block of bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    return [mix64((total[w:] - total[: len(data) + 1 - w]) * _DOWN[: len(data) + 1 - w]) for w in widths]


def all_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of every string of ``width`` bytes, block by block."""
    return np.concatenate([rolling(data[k : k + BLOCK + width - 1], width)[0] for k in range(0, len(data) - width + 1, BLOCK)] or [np.zeros(0, np.uint64)])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` values in a row, from running minima of blocks to either side."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of starts with one least hash: hash, first start, number of starts, and whether a run may repeat inside itself."""
    gram = min(GRAM, length)
    width = length - gram + 1
    for begin in range(0, len(data) - length + 1, BLOCK):
        block = data[begin : begin + BLOCK + length - 1]
        (grams,) = rolling(block, gram)
        least = sliding_least(grams, width)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        count = np.diff(np.append(first, len(least)))
        # places that hold the least hash of some window around them; two in a row with one hash may be a repetition
        wide = np.full(len(grams) + width - 1, np.iinfo(np.uint64).max, np.uint64)
        wide[width - 1 : width - 1 + len(least)] = ~least
        held = np.flatnonzero(grams == ~sliding_least(wide, width))
        twice = np.concatenate([[0], np.cumsum(grams[held[1:]] == grams[held[:-1]])])
        low = np.searchsorted(held, first, "left")
        high = np.searchsorted(held, first + count + width - 2, "right") - 1
        yield least[first].view(np.int64), first + begin, count, twice[np.maximum(high, low)] > twice[low]


def covered(marked: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans that the windows at the marked starts cover."""
    at = np.sort(starts[marked])
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return list(zip(at[np.concatenate([[0], cut])].tolist(), (at[np.concatenate([cut - 1, [len(at) - 1]])] + length).tolist()))


def suffix_ranks(data: np.ndarray, depth: int, coarse: int = 1) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first w bytes, for w of 8, 16, 32 ... and at last ``depth``; the end is filled with zeros.

    With ``coarse`` the first w is that, and its order that of fingerprints.
    """
    n = len(data)
    width = min(max(8, coarse), depth)
    key = np.zeros(n, np.uint64)
    if coarse > 1:
        hashes = all_hashes(data, width)
        key[: len(hashes)] = hashes
    else:
        filled = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint64)
        for k in range(width):
            key = key << np.uint64(8) | filled[k : n + k]
    levels = []
    while True:
        _, rank = np.unique(key, return_inverse=True)
        levels.append((width, rank.astype(np.int64)))
        if width == depth:
            return levels
        step = min(width, depth - width)
        # what begins ``step`` later; beyond the end there are zeros only, which come first
        later = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        key = rank.astype(np.uint64) * np.uint64(n + 1) + later.astype(np.uint64)
        width += step


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before, and after, with a smaller value; -1 and n where there is none."""

    def before(v):
        # a place whose value is not smaller points on to a place that is nearer to the answer
        found = np.arange(-1, len(v) - 1)
        while True:
            bad = np.flatnonzero((found >= 0) & (v[np.maximum(found, 0)] >= v))
            if not len(bad):
                return found
            found[bad] = found[found[bad]]

    return before(values), len(values) - 1 - before(values[::-1])[::-1]


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common beginning of the suffixes at ``a`` and ``b``, at most ``depth``; a multiple of the first level if that is not 8."""
    size = np.zeros(len(a), np.int64)
    whole = levels[-1][1][a] == levels[-1][1][b]
    for width, rank in reversed(levels[:-1]):
        fits = (size + width <= depth) & ~whole
        at = np.where(fits, size, 0)
        size += width * (fits & (rank[a + at] == rank[b + at]))
    for _ in range(0 if levels[0][0] > 8 and len(levels) > 1 else min(8, depth) - 1 if len(levels) > 1 else depth):
        open_ = (size < depth) & ~whole
        at = np.where(open_, size, 0)
        size += open_ & (data[a + at] == data[b + at])
    return np.where(whole, depth, size)


def longest_previous(data: np.ndarray, starts: np.ndarray, places: np.ndarray, depth: int, coarse: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors, up to ``depth``, of the suffixes at ``starts``, and which earlier start has it (-1: none).

    ``places`` order the starts in the corpus and are distinct; ``depth`` bytes follow every start. With ``coarse``, factors below
    ``depth`` are only lower bounds, multiples of it.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = suffix_ranks(data, depth, coarse)
    order = np.lexsort((places, levels[-1][1][starts]))
    best, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for near in nearest_smaller(places[order]):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        mine, earlier = order[has], order[near[has]]
        size = common_prefix(data, levels, starts[mine], starts[earlier], depth)
        more = size > best[mine]
        best[mine[more]], source[mine[more]] = size[more], earlier[more]
    return best, source


def matched(data: np.ndarray, starts: np.ndarray, places: np.ndarray, depth: int, keep_first: bool) -> np.ndarray:
    """Which starts have an earlier match of ``depth`` bytes (or any, without ``keep_first``)."""
    best, source = longest_previous(data, starts, places, depth, min(COARSE, depth))
    found = best >= depth
    if not keep_first:
        found[source[found]] = True
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of merged spans."""
    bounds = [0, *chain.from_iterable(spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2]))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with their text as bytes (a null one empty) and its md5 as key."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", data.alias("data")).withColumn("key", F.md5("data"))


def first_ids(texts: DataFrame) -> DataFrame:
    return texts.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def repeated_spans(texts: DataFrame, keep_first: bool, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Spans to remove in the distinct texts of ``keyed`` documents: key, spans (array of start and end, not merged).

    A text without any has no row. Positions are ordered by the first document of a text (null ids last), then by key, then
    by place. Whole copies of a text are not looked at here.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "bucket", "start", "n", "inside"]
        for batch in batches:
            made = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(value.as_buffer(), np.uint8)
                made += [(key, *run) for run in runs_of(data, length)]
            if made:
                keys = pa.array([m[0] for m in made]).take(pa.array(np.repeat(np.arange(len(made)), [len(m[1]) for m in made])))
                bucket, start, n, inside = (np.concatenate([m[k] for m in made]) for k in (1, 2, 3, 4))
                columns = [keys, pa.array(bucket), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inside)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    long_texts = texts.where(F.octet_length("data") >= length)
    runs = save(long_texts.select("key", "data").mapInArrow(cut, "key string, bucket long, start int, n int, inside boolean"), "runs")
    place = F.xxhash64("key", "start")
    buckets = runs.groupBy("bucket").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max(F.col("inside").cast("int")).alias("inside"), F.sum("n").alias("starts"))
    shared = save(buckets.where("low <> high OR inside = 1").select("bucket", F.ceil(F.col("starts") / chunk).cast("int").alias("parts")), "buckets")
    wanted = runs.join(shared, "bucket").select("key", F.struct("start", "n", "bucket", "parts").alias("run"))
    # the copies of a text name the same runs; each is kept once
    lists = wanted.groupBy("key").agg(F.collect_set("run").alias("runs"))
    lists = lists.join(first_ids(long_texts).select("key", "first_id"), "key").withColumnRenamed("key", "key2")
    one = texts.join(lists, F.expr("key = key2 AND doc_id <=> first_id")).dropDuplicates(["key"])
    run = F.col("run")
    pieces = one.select("key", "first_id", "data", F.explode("runs").alias("run")).select(
        run["bucket"].alias("bucket"),
        run["parts"].alias("parts"),
        F.col("first_id").isNull().alias("last"),
        "first_id",
        "key",
        run["start"].alias("start"),
        F.substring("data", run["start"] + 1, run["n"] + (length - 1)).alias("data"),
    )
    big = shared.where("parts > 1").limit(1).count() > 0
    pieces = save(pieces, "pieces") if big else pieces
    batch = min(BATCH, chunk)
    spans = _small_buckets(pieces.where("parts = 1") if big else pieces, keep_first, length, batch)
    if big:
        spans = spans.unionByName(_big_buckets(pieces.where("parts > 1"), keep_first, length, batch))
    return spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_SPANS = "key string, spans array<struct<start: long, end: long>>"
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _prints_of(data: bytes, length: int) -> np.ndarray:
    """Fingerprints of all windows of a run's bytes."""
    return all_hashes(np.frombuffer(data, np.uint8), length)


def _found(keys: list[str], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    values = [[{"start": a, "end": b} for a, b in s] for s in spans]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, _SPANS_TYPE)], names=["key", "spans"])


def _repeated(prints: np.ndarray) -> np.ndarray:
    """Which values stand there more than once."""
    low = (prints & np.uint64((1 << 20) - 1)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(low, minlength=1 << 20)[low] > 1)
    _, place, count = np.unique(prints[maybe], return_inverse=True, return_counts=True)
    out = np.zeros(len(prints), bool)
    out[maybe] = count[place] > 1
    return out


def _small_buckets(pieces: DataFrame, keep_first: bool, length: int, batch: int) -> DataFrame:
    """Spans found in buckets that fit a task, by longest previous factors."""

    def work(rows: list[tuple]) -> pa.RecordBatch | None:
        prints = [_prints_of(r[6], length) for r in rows]
        again = np.split(_repeated(np.concatenate(prints)), np.cumsum([len(p) for p in prints])[:-1])
        # of each run, from the first repeated window to the last
        cut = []
        for row, some in zip(rows, again):
            at = np.flatnonzero(some)
            if len(at):
                cut.append(((row[2], row[3] or 0, row[4]), row[5] + int(at[0]), row[6][at[0] : at[-1] + length]))
        if not cut:
            return None
        # texts in their order: by first document, null ids last, then by key
        texts = {t: k for k, t in enumerate(sorted({c[0] for c in cut}))}
        sizes = [len(c[2]) - length + 1 for c in cut]
        begin = np.cumsum([0, *[len(c[2]) for c in cut]])
        bounds = np.cumsum([0, *sizes])
        inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        offset = inside + np.repeat([c[1] for c in cut], sizes)
        places = (np.repeat([texts[c[0]] for c in cut], sizes) << 40) + offset
        data = np.frombuffer(b"".join(c[2] for c in cut), np.uint8)
        hits = matched(data, np.repeat(begin[:-1], sizes) + inside, places, length, keep_first)
        spans = [covered(hits[a:b], offset[a:b], length) for a, b in zip(bounds, bounds[1:])]
        some = [k for k, s in enumerate(spans) if s]
        return _found([cut[k][0][2] for k in some], [spans[k] for k in some]) if some else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        starts = 0
        for rows in groups(batches, 1):
            size = sum(len(r[6]) - length + 1 for r in rows)
            if held and starts + size > batch:
                made = work(held)
                if made is not None:
                    yield made
                held, starts = [], 0
            held += rows
            starts += size
        made = work(held) if held else None
        if made is not None:
            yield made

    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _SPANS)


def _big_buckets(pieces: DataFrame, keep_first: bool, length: int, batch: int) -> DataFrame:
    """Spans found in buckets beyond a task: counts and first places of fingerprints, merged and joined back.

    Windows travel packed: a row holds the texts that it speaks of and, for every window, fingerprint, start, number, and place of
    its text in that list.
    """
    fields = {f.name: f.dataType for f in pieces.schema}
    text = T.StructType([T.StructField(n, fields[n]) for n in ("last", "first_id", "key")])
    packed = T.StructType(
        [
            T.StructField("bucket", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()),
            T.StructField("texts", T.ArrayType(text)), T.StructField("data", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(packed)

    def order_of(t: dict) -> tuple:
        return t["last"], t["first_id"] or 0, t["key"]

    def pack(bucket: int, part: int, texts: list[dict], columns: list[np.ndarray], n: int) -> dict:
        used, place = np.unique(columns[3], return_inverse=True)
        data = b"".join(np.ascontiguousarray(c).astype(np.int64).tobytes() for c in (*columns[:3], place))
        return {"bucket": bucket, "part": part, "n": n, "texts": [texts[k] for k in used], "data": data}

    def unpack(rows: list[dict]) -> tuple[list[dict], list[np.ndarray]]:
        """All texts in their order, and the windows of all rows."""
        texts = sorted({order_of(t): t for r in rows for t in r["texts"]}.values(), key=order_of)
        index = {order_of(t): k for k, t in enumerate(texts)}
        parts = [np.frombuffer(r["data"], np.int64).reshape(4, -1) for r in rows]
        of = [np.array([index[order_of(t)] for t in r["texts"]], np.int64)[p[3]] for r, p in zip(rows, parts)]
        return texts, [*[np.concatenate([p[k] for p in parts]) for k in range(3)], np.concatenate(of)]

    def counted(columns: list[np.ndarray]) -> list[np.ndarray]:
        """One window of each fingerprint, the first, with the sum of the numbers."""
        prints, starts, n, of = columns
        order = np.lexsort((starts, of, prints))
        first = np.flatnonzero(np.concatenate([[True], prints[order][1:] != prints[order][:-1]]))
        return [prints[order[first]], starts[order[first]], np.add.reduceat(n[order], first), of[order[first]]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}
        size = 0

        def sent():
            made = []
            for (bucket, part), (texts, columns) in held.items():
                whole = [np.concatenate([c[k] for c in columns]) for k in range(4)]
                made.append(pack(bucket, part, texts, whole, len(whole[0])))
            return pa.RecordBatch.from_pylist(made, schema=arrow)

        for rows in batches:
            for row in rows.to_pylist():
                prints = _prints_of(row["data"], length)
                part = prints % np.uint64(row["parts"])
                order = np.argsort(part, kind="stable")
                for s in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    texts, columns = held.setdefault((row["bucket"], int(part[s[0]])), ([], []))
                    columns.append([prints[s].view(np.int64), row["start"] + s, np.ones(len(s), np.int64), np.full(len(s), len(texts))])
                    texts.append({n: row[n] for n in ("last", "first_id", "key")})
                size += len(prints)
                if size > batch:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()

    windows = save(pieces.mapInArrow(spread, packed), "windows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made = []
            for row in rows.to_pylist():
                texts, columns = unpack([row])
                made.append(pack(row["bucket"], row["part"], texts, counted(columns), row["n"]))
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts, columns = unpack(rows)
        whole = counted(columns)
        again = whole[2] > 1
        made = pack(rows[0]["bucket"], rows[0]["part"], texts, [c[again] for c in whole], sum(r["n"] for r in rows))
        return pa.Table.from_pylist([made], schema=arrow)

    known = save(windows.mapInArrow(count, packed).groupBy("bucket", "part").applyInArrow(merge, packed), "repeated")
    tasks = F.ceil(F.col("n") / (4 * batch)).cast("int")
    known = known.select("bucket", "part", "texts", "data", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"))
    many = known.groupBy("bucket", "part").agg(F.count("*").alias("tasks"))
    dealt = windows.join(many, ["bucket", "part"]).withColumn("salt", F.pmod(F.xxhash64("data"), F.col("tasks")).cast("int")).select("bucket", "part", "texts", "data", "salt")

    def mark(table: pa.Table, other: pa.Table) -> pa.Table:
        if not len(table) or not len(other):
            return pa.table([pa.array([], pa.string()), pa.array([], _SPANS_TYPE)], names=["key", "spans"])
        texts, (prints, starts, _, of) = unpack(table.to_pylist())
        first_texts, (repeated, first_starts, _, first_of) = unpack(other.to_pylist())
        if not len(repeated):
            return mark(table.slice(0, 0), other)
        order = np.argsort(repeated)
        at = order[np.minimum(np.searchsorted(repeated[order], prints), len(order) - 1)]
        hit = repeated[at] == prints
        if keep_first:
            names = {t["key"]: k for k, t in enumerate(texts)}
            same = np.array([names.get(t["key"], -1) for t in first_texts])
            hit &= (same[first_of[at]] != of) | (first_starts[at] != starts)
        marked = np.unique(of[hit])
        return pa.Table.from_batches([_found([texts[k]["key"] for k in marked], [covered(hit[of == k], starts[of == k], length) for k in marked])])

    keys = ["bucket", "part", "salt"]
    return dealt.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(mark, _SPANS)


def with_kept(texts: DataFrame) -> DataFrame:
    """Add ``kept`` (the bytes outside the spans) and ``n_spans`` (maximal removed runs) to texts with ``data`` and ``spans``."""

    def make():
        def rows(data, spans):
            whole = [merged([(s["start"], s["end"]) for s in some or []]) for some in spans]
            return [[cut_out(d, s) for d, s in zip(data, whole)], [len(s) for s in whole]]

        return rows

    return with_arrow(texts, ["data", "spans"], T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_spans", T.LongType())]), make)


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document, with every repeated string removed wherever it stands: bytes, removed bytes and runs, digest of the rest.

    A text of ``length`` bytes or more that another row repeats as a whole goes as a whole. Shorter, empty and null texts
    have nothing removed.
    """
    texts = keyed(docs)
    copies = first_ids(texts)
    single = repeated_spans(texts, False, length).join(copies.where("copies = 1").select("key"), "key")
    cut = with_kept(texts.join(single, "key")).select("key", F.octet_length("kept").alias("left"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    plain = texts.select("doc_id", "key", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha256"))
    several = copies.where("copies > 1").select("key", F.lit(True).alias("several"))
    joined = plain.join(several, "key", "left").join(cut, "key", "left")
    gone = F.coalesce("several", F.lit(False)) & (F.col("n_bytes") >= length)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def without_later_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with every repeated string left in its first place only; ``n_chars`` follows the text, all else stays.

    A copy of a whole text of ``length`` bytes or more is emptied, but for the document of the least id; rows that repeat an
    id and a text count as one document and are treated alike. A sign that a cut splits is dropped.
    """
    texts = keyed(docs)
    info = first_ids(texts).join(repeated_spans(texts, True, length), "key", "left").where("copies > 1 OR spans IS NOT NULL")
    key, first, spans = unused(docs, "key", "first", "spans")
    info = info.select(F.col("key").alias(key), F.col("first_id").alias(first), F.col("spans").alias(spans))
    joined = docs.join(info, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) == F.col(key), "left")
    later = F.col(key).isNotNull() & ~F.col("doc_id").eqNullSafe(F.col(first)) & (F.octet_length("text") >= length)

    def make():
        def rows(values, found):
            return [[v if not s else cut_out(v.encode(), merged([(x["start"], x["end"]) for x in s])).decode("utf-8", "ignore") for v, s in zip(values, found)]]

        return rows

    emptied = joined.withColumn("text", F.when(later, F.lit("")).otherwise(F.col("text"))).withColumn(spans, F.when(~later, F.col(spans)))
    cut = with_arrow(emptied, ["text", spans], T.StructType([T.StructField("text", T.StringType())]), make)
    changed = F.col(key).isNotNull()
    out = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else cut
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
