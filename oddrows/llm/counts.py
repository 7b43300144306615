"""Token counts without tokens: a heap and a linked list per word."""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import with_arrow

SPACE = "▁"
# Words whose count a task remembers.
MEMORY = 500_000
# Longer words are counted anew each time.
LONG = 100


def read_pieces(path: str) -> tuple[dict[str, int], bool]:
    """Merge ranks of the ordinary pieces of a ``.model`` file (a bounded vocabulary), and whether unknown signs fall back to bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    special = [i for i in every if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
    plain = sorted(set(every).difference(special), key=lambda i: (-model.get_score(i), i))
    if any(model.is_unused(i) for i in plain):
        raise ValueError("models with unused pieces are not supported")
    if model.encode("A  b", out_type=str) and "".join(model.encode("A  b ", out_type=str)) != f"{SPACE}A{SPACE}{SPACE}b{SPACE}":
        raise ValueError("only models that keep the text as it is and put one space before it are supported")
    # equal scores are equal ranks: then the leftmost pair goes first
    ranks, rank, last = {}, -1, None
    for i in plain:
        if (score := model.get_score(i)) != last:
            rank, last = rank + 1, score
        ranks[model.id_to_piece(i)] = rank
    return ranks, any(model.is_byte(i) for i in every)


def merges(word: str, ranks: dict[str, int]) -> tuple[int, list[str]]:
    """Number of merges in a word, and the signs that took part in none.

    The heap holds the mergeable adjacent pairs by rank, then place; ``at`` has the rank of the pair that starts at a place
    now, so an entry whose symbols have changed since is passed over. Symbols form a linked list.
    """
    size, get = len(word), ranks.get
    at = [get(a + b, -1) for a, b in zip(word, word[1:])]
    heap = [r * size + k for k, r in enumerate(at) if r >= 0]
    if not heap:
        return 0, [*word]
    heapify(heap)
    at.append(-1)
    symbol = [*word]
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    done = 0
    while heap:
        entry = heappop(heap)
        k = entry % size
        if at[k] != entry // size:
            continue
        done += 1
        n = after[k]
        text = symbol[k] = symbol[k] + symbol[n]
        symbol[n], at[n], r = "", -1, -1
        after[k] = n = after[n]
        if n < size:
            before[n] = k
            r = get(text + symbol[n], -1)
            if r >= 0:
                heappush(heap, r * size + k)
        at[k] = r
        b = before[k]
        if b >= 0:
            r = at[b] = get(symbol[b] + text, -1)
            if r >= 0:
                heappush(heap, r * size + b)
    return done, [s for s in symbol if len(s) == 1]


def with_token_count(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Add ``count`` (long): tokens of each whole text as the model gives them. A null or empty text has 0.

    A word's count is its initial symbols less its merges, plus the extra bytes of signs the vocabulary lacks. Texts are cut
    between two signs that no piece of the vocabulary has side by side, as no merge can reach across.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_pieces(path))
    memory = MEMORY

    def make():
        ranks, fallback = vocabulary.value
        beside = {p[k : k + 2] for p in ranks for k in range(len(p) - 1)}
        cut_at_space = not any(pair[1] == SPACE and pair[0] != SPACE for pair in beside)
        cut_at_line = not any("\n" in pair for pair in beside)
        spaced = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        words: dict[str, int] = {}
        parts: dict[str, int] = {}

        def remember(known: dict[str, int], word: str, count: int) -> None:
            if len(known) >= memory:
                known.clear()
            if len(word) <= LONG:
                known[word] = count

        def part_count(part: str) -> int:
            made, single = merges(part, ranks)
            extra = sum(len(s.encode()) - 1 for s in single if s not in ranks) if fallback else 0
            return len(part) - made + extra

        def learn(word: str) -> int:
            total = start = 0
            for k in [*[k for k, pair in enumerate(map(add, word, word[1:]), 1) if pair not in beside], len(word)]:
                part, start = word[start:k], k
                if (c := parts.get(part)) is None:
                    c = part_count(part)
                    remember(parts, part, c)
                total += c
            remember(words, word, total)
            return total

        def total_of(found) -> int:
            total = 0
            for w in found:
                c = words.get(w)
                total += learn(w) if c is None else c
            return total

        def count_of(value: str | None) -> int:
            if not value:
                return 0
            marked = SPACE + value.replace(" ", SPACE)
            if not cut_at_space:
                return learn(marked)
            total = 0
            for k, line in enumerate(marked.split("\n") if cut_at_line else [marked]):
                if k:
                    total += total_of("\n")
                if SPACE * 2 in line:
                    total += total_of(spaced.findall(line))
                elif line:
                    first, *rest = line.split(SPACE)
                    total += total_of([SPACE + w for w in rest])
                    if first:
                        total += total_of([first])
            return total

        return lambda texts: [[count_of(t) for t in texts]]

    return with_arrow(df, [text], T.StructType([T.StructField(count, T.LongType())]), make)


def token_counts(df: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    small = df.select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return with_token_count(small, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
