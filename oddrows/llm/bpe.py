"""Byte-level BPE by merge replay over the words of a block of documents.

A task collects the distinct pieces of its documents, lays them out as one chain of symbols, and keeps an inverted index from
each adjacent symbol pair to the places where it stands. The pair of the lowest rank is merged at all of its places, in every
word at once; only the two neighbours of a merged place change, and only their index entries are touched. Words are
independent, so replaying a block gives what replaying the whole corpus would, without moving a document. Words seen before
in a task are remembered, up to ``memory`` of them.
"""

from __future__ import annotations

import base64
import re
import sys
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import with_arrow

# Pieces that are held at a time, of one document or of many.
PIECES = 400_000
# Rows that a worker turns into texts at a time.
SLICE = 1024
# Words that a task remembers.
MEMORY = 300_000
# Letters and digits of the Latin blocks; a text of these and of common signs can be split by the faster standard engine.
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
LATIN_DIGITS = "0-9²³¹¼-¾"
LATIN_TEXT = "[\\t-\\r -~\\x85-ʯ‐-‧‰-⁞]*"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line (a vocabulary: bounded, and read by the driver)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def splitter(pattern: str):
    """A function from a text to its pieces.

    Texts of Latin letters go to the standard engine with the classes written out, others to the engine that knows all
    properties; both give the same pieces.
    """
    full = regex.compile(pattern)
    known = {r"\p{L}": LATIN_LETTERS, r"\p{N}": LATIN_DIGITS}

    def written_out(part: str, around: str) -> str:
        for name, signs in known.items():
            part = part.replace(name, around.format(signs))
        return part

    parts = re.split(r"(\[[^\]]*\])", pattern)
    latin = re.compile("".join(written_out(part, "{}" if part.startswith("[") else "[{}]") for part in parts))
    simple = re.compile(LATIN_TEXT)

    def find(text: str):
        engine = latin if simple.fullmatch(text) else full
        if len(text) <= PIECES:
            yield engine.findall(text)
            return
        found = engine.finditer(text)
        while block := [m.group() for m in islice(found, PIECES)]:
            yield block

    return find


def reaches_below(ranks: dict[bytes, int]) -> set[int]:
    """Ranks whose token begins or ends a token of a lower rank: merging to one may make a pair to merge before the rest."""
    found = set()
    for token, rank in ranks.items():
        for cut in range(2, len(token)):
            for part in (token[:cut], token[-cut:]):
                if ranks.get(part, -1) > rank:
                    found.add(ranks[part])
    return found


def replay(words: list[bytes], ranks: dict[bytes, int], tokens: dict[int, bytes], early: set[int]) -> list[bytes]:
    """Token ids of each word, as 32-bit integers: merges in rank order over all words at once.

    ``early`` is ``reaches_below(ranks)``: a pair that merges to such a rank is merged once per word, leftmost first, before
    the lowest rank is looked for again. The result is that of merging the lowest-ranked leftmost pair of each word in turn.
    """
    chained = b"".join(words)
    size = len(chained)
    ends = np.cumsum(np.array([len(w) for w in words], dtype=np.int64))
    starts = np.concatenate([[0], ends[:-1]])
    real = ends > starts
    symbols = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
    # one more symbol at the end is the neighbour of word ends
    none, wide = size, 1 << 32
    sym = np.concatenate([symbols[np.frombuffer(chained, np.uint8)], [-1]])
    after, before = np.arange(1, size + 2), np.arange(-1, size)
    after[ends[real] - 1] = none
    before[starts[real]] = none
    # the index: places of each mergeable pair, in arrays; None for a pair that no rank merges
    places: dict[int, list[np.ndarray] | None] = {}
    heap: list[tuple[int, int]] = []

    def enter(pairs: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(pairs, kind="stable")
        pairs, at = pairs[order], at[order]
        cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        firsts = [0, *cuts.tolist()]
        for value, a, b in zip(pairs[firsts].tolist(), firsts, [*firsts[1:], len(at)]):
            known = places.get(value, ())
            if known:
                known.append(at[a:b])
            elif known is not None:
                rank = ranks.get(tokens[value // wide] + tokens[value % wide])
                places[value] = None if rank is None else [at[a:b]]
                if rank is not None:
                    heappush(heap, (rank, value))

    inside = np.flatnonzero(after[:size] != none)
    if len(inside):
        enter(sym[inside] * wide + sym[inside + 1], inside)
    while heap:
        rank, value = heappop(heap)
        left, right = value // wide, value % wide
        found, places[value] = places[value], []
        p = np.unique(np.concatenate(found))
        p = p[sym[p] == left]
        q = after[p]
        stands = sym[q] == right
        p, q = p[stands], q[stands]
        if left == right and len(p) > 1:
            # in a run of equal symbols every second place is taken
            follows = np.concatenate([[False], q[:-1] == p[1:]])
            index = np.arange(len(p))
            taken = (index - np.maximum.accumulate(np.where(follows, 0, index))) % 2 == 0
            p, q = p[taken], q[taken]
        if rank in early and len(p) > 1:
            word = np.searchsorted(ends, p, side="right")
            first = np.concatenate([[True], word[1:] != word[:-1]])
            if not first.all():
                enter(np.full((~first).sum(), value), p[~first])
            p, q = p[first], q[first]
        if not len(p):
            continue
        n = after[q]
        sym[p], sym[q], after[p] = rank, -2, n
        before[n] = p
        b = before[p]
        r, s = n != none, b != none
        if r.any() or s.any():
            enter(np.concatenate([rank * wide + sym[n[r]], sym[b[s]] * wide + rank]), np.concatenate([p[r], b[s]]))
    stands = sym[:size] >= 0
    ids = sym[:size][stands].astype(np.int32).tobytes()
    cuts = (4 * np.concatenate([[0], np.cumsum(stands)])[np.concatenate([[0], ends])]).tolist()
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _encoder(vocabulary, pattern: str):
    """Per task: a function from texts to an Arrow array of id lists."""
    ranks = vocabulary.value
    tokens = {r: b for b, r in ranks.items()}
    early = reaches_below(ranks)
    find = splitter(pattern)
    known: dict[str, bytes] = {}

    def learn(words: set[str]) -> None:
        new = list(words.difference(known))
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(words)
        raw = [w.encode() for w in new]
        whole = [ranks.get(b) for b in raw]
        known.update((w, i.to_bytes(4, sys.byteorder)) for w, i in zip(new, whole) if i is not None)
        rest = [k for k, i in enumerate(whole) if i is None]
        known.update(zip([new[k] for k in rest], replay([raw[k] for k in rest], ranks, tokens, early)))

    def encoded(texts: list[str | None]) -> pa.ListArray:
        # documents are learnt in blocks, so that many words share one replay
        made: list[np.ndarray | None] = [None] * len(texts)
        block: list[tuple[int, list[str]]] = []
        count = 0

        def flush():
            nonlocal count
            learn(set(chain.from_iterable(p for _, p in block)))
            for k, p in block:
                got = np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32)
                made[k] = got if made[k] is None else np.concatenate([made[k], got])
            block.clear()
            count = 0

        for k, t in enumerate(texts):
            for pieces in find(t or ""):
                block.append((k, pieces))
                count += len(pieces)
                if count >= PIECES:
                    flush()
        if block:
            flush()
        made = [np.empty(0, np.int32) if m is None else m for m in made]
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made) if made else np.empty(0, np.int32)))

    return encoded


def _decoder(vocabulary):
    """Per task: a function from an Arrow array of id lists to bytes."""
    token = {r: b for b, r in vocabulary.value.items()}.__getitem__

    def decoded(lists: pa.ListArray) -> list[bytes]:
        flat, bounds = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))]).tolist()
        return [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(bounds, bounds[1:])]

    return decoded


def id_field(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.IntegerType()))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int): the tokens of each whole text, without special tokens. A null or empty text has none.

    Repeated rows give equal ids, and a column called ``ids`` is replaced.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        encoded = _encoder(vocabulary, pattern)
        return lambda texts: [encoded(texts)]

    return with_arrow(df, [text], T.StructType([id_field(ids)]), make, rows=SLICE)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of each list of ids; of a null or empty list, no bytes."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        read = _decoder(vocabulary)
        return lambda lists: [read(lists)]

    return with_arrow(df, [ids], T.StructType([T.StructField(decoded, T.BinaryType())]), make, raw=True)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, by one worker a task."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        write, read = _encoder(vocabulary, pattern), _decoder(vocabulary)

        def rows(texts):
            lists = write(texts)
            return [lists, read(lists)]

        return rows

    return with_arrow(df, [text], T.StructType([id_field(ids), T.StructField(decoded, T.BinaryType())]), make, rows=SLICE)


def token_digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the bytes decoded from them."""
    coded = round_trip(df.select("doc_id", "text"), path, pattern).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
