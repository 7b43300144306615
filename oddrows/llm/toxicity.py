"""Toxicity over text restored from a noisy channel.

A word with digits, signs or long runs of one sign among its letters is a lattice: each sign may stand for itself, for a letter
it resembles, or for nothing (a separator, a repetition). Viterbi decoding picks the letters that a trigram model of
characters, counted over all documents, and the channel's costs make likeliest. Single signs set apart by spaces are joined.
In a run of words of one or two signs each blank is dropped or stays the edge of a word, as the words of the labelled texts
make likeliest. The score is a logistic model over the restored words and their beginnings.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.llm.common import SLICE_ROWS, with_arrow
from oddrows.llm.lasso import fit_sparse_lasso
from oddrows.llm.quality import fold, labelled
from oddrows.session import at_most, cut_lineage

# What a sign may stand for (fixed values: common look-alikes).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "ı": "i",
}
SEPARATORS = ".-_*'~^`,:;/\\=#·•"
# Costs of the channel in nats: a look-alike, a dropped separator, a dropped repetition.
LOOK, DROP, REPEAT = 1.0, 0.5, 0.5
# Letters of the model by code; 0 is a word's edge, the last code any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)]))
SIZE = len(LETTERS) + 2
CODE = {c: k for k, c in enumerate(LETTERS, 1)}
# Words that a task remembers, different words and words of documents that it counts at a time, documents restored at a time.
MEMORY, COUNT_WORDS, FEATURE_WORDS, COUNT_ROWS = 200_000, 200_000, 1_000_000, 256
# Signs of texts whose words are looked for at once.
BLOCK_SIGNS = 500_000
# Signs at the beginning of a word that are a feature, from the fewest to the most.
FIRST, LAST = 3, 8
# Labels that are broadcast, and different rows of the fit in a task.
LABEL_ROWS, FIT_ROWS = 1_000_000, 50_000
# Readings and runs of spaced pieces that a task remembers.
PIECE_MEMORY = 50_000

SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
EDGE = "\"'.,;:?!()[]{}<>*_-~#%&=/\\"
FRONT = "\"'.,;:?()[]{}<>"
# Words of the labelled texts that are known when a spaced run is parted, the cost in nats of a word that is not among them on
# top of its letters, and the most pieces of a word.
LEXICON, UNKNOWN, PIECES = 100_000, 3.0, 24
PLAIN = re.compile(r"[^\W\d_]*")
RUN = re.compile(r"(.)\1{2,}", re.S)
# Kinds of words, one sign each: a single sign, another piece of a spaced run, any other.
SINGLES, RUNS = re.compile("s{3,}"), re.compile("[sp]{3,}")
# What a sign is, by its code: a blank, a mark of FRONT, one of EDGE, a letter that is its own lower case; beyond the table nothing.
BLANK, IN_FRONT, AT_EDGE, LETTER = 1, 2, 4, 8
SIGNS = np.zeros(0x10001, np.uint8)
for _c in map(chr, range(len(SIGNS) - 1)):
    SIGNS[ord(_c)] = BLANK * _c.isspace() + IN_FRONT * (_c in FRONT) + AT_EDGE * (_c in EDGE) + LETTER * (_c.isalpha() and _c == _c.lower())


class Remembered(dict):
    """What a function gives for a key; all is forgotten when ``most`` keys are held."""

    def __init__(self, make: Callable, most: int = MEMORY):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        found = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


def letter_code(c: str) -> int:
    return CODE.get(c) or (SIZE - 1 if c.isalpha() else 0)


def letter_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, as an array over three codes.

    Each task sums its rows; what reaches the driver is bounded by the number of trigrams of the alphabet.
    """
    codes = np.full(0x250, 0, np.int64)
    for k in range(len(codes)):
        codes[k] = letter_code(chr(k).lower()[0])
    size = SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**3, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                joined = "\n\n".join(t for t in batch.column(0).slice(start, SLICE_ROWS).to_pylist() if t)
                points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le"), np.uint32)
                # beyond the Latin blocks a sign counts as another letter
                c = np.where(points < len(codes), codes[np.minimum(points, len(codes) - 1)], size - 1)
                # between two words only one edge is kept
                c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])] if c.any() else c[:0]
                if len(c) > 2:
                    total += np.bincount((c[:-2] * size + c[1:-1]) * size + c[2:], minlength=size**3)
        at = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    rows = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "trigram long, n long")
    counts = np.zeros(size**3, np.int64)
    for r in rows.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r["trigram"]] = r["n"]
    return counts.reshape(size, size, size)


class LetterModel:
    """Costs in nats of a letter after the two before it, smoothed by pairs and single letters."""

    def __init__(self, counts: np.ndarray, words: dict[str, float] | None = None):
        three = counts.astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.keep(-np.log(p3), words or {})

    def keep(self, cost: np.ndarray, words: dict[str, float]) -> None:
        # single costs are found sooner in lists
        self.cost, self.words, self.table = cost, words, cost.tolist()
        self.costs, self.runs = Remembered(self.cost_of, PIECE_MEMORY), Remembered(self.cheapest, PIECE_MEMORY)

    def decode(self, word: str) -> str:
        """The letters of the cheapest path through the lattice of a word."""
        cost = self.table
        # a state is the last two codes; its value the cost so far and the letters
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for run in re.finditer(r"(.)\1*", word, re.S):
            sign, n = run[1], run.end() - run.start()
            choices: list[tuple[float, str]] = []
            extra = REPEAT * (n - 1)
            if sign.isalpha():
                choices += [(extra, sign)] + ([(extra - REPEAT, sign * 2)] if n > 1 else [])
            for look in LOOKS.get(sign, ""):
                choices += [(LOOK + extra, look)] + ([(2 * LOOK + extra - REPEAT, look * 2)] if n > 1 else [])
            if sign in SEPARATORS or not choices:
                choices.append((DROP + extra, ""))
            following: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (spent, path) in states.items():
                for price, letters in choices:
                    x, y, total, now = a, b, spent + price, path
                    for letter in letters:
                        z = letter_code(letter)
                        total += cost[x][y][z]
                        x, y, now = y, z, (now, letter)
                    if (x, y) not in following or total < following[x, y][0]:
                        following[x, y] = (total, now)
            states = following
        _, path = min((spent + cost[a][b][0], path) for (a, b), (spent, path) in states.items())
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def restore_word(self, word: str) -> str:
        """A word in lower case without marks around it; decoded if its letters are mixed with other signs or repeated."""
        bare = word.lower().strip(EDGE)
        if (bare.isalpha() or PLAIN.fullmatch(bare)) and not RUN.search(bare):
            return bare
        # a mark at the front can be a letter's look-alike, as can a dollar or an at sign at either end
        inner = word.lower().lstrip(FRONT).rstrip(EDGE)
        return self.decode(inner) if any(map(str.isalpha, inner)) else bare

    def restore(self, text: str | None) -> str:
        """The whole text with every word restored and single signs joined; of a null text, an empty one."""
        return " ".join(map(self.restore_word, self.joined_words(text)))

    def cost_of(self, word: str) -> float:
        """Cost in nats of a word of a spaced run, as it is read."""
        read = self.restore_word(word)
        if read in self.words:
            return self.words[read]
        if not read:
            return DROP
        codes = [0, 0, *map(letter_code, read), 0]
        total = 0.0
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += self.table[a][b][c]
        return UNKNOWN + total

    def cheapest(self, run: tuple[tuple[str, bool], ...]) -> list[str]:
        """The words of a run of pieces, by the cheapest choice of the blanks that go; a piece marked as such begins a word."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            found, word = [], ""
            for start in range(end - 1, max(-1, end - 1 - PIECES), -1):
                word = run[start][0] + word
                found.append((best[start][0] + self.costs[word], start))
                if run[start][1]:
                    break
            best.append(min(found))
        words, end = [], len(run)
        while end:
            start = best[end][1]
            words.append("".join(piece for piece, _ in run[start:end]))
            end = start
        return words[::-1]

    def joined_words(self, text: str | None) -> list[str]:
        """Words of a text, single signs set apart by spaces also joined to one word, and the words of spaced runs."""
        found = WordTable([text])
        return found.words_of(0) + self.made_words(found, 0)

    def made_words(self, found: WordTable, row: int) -> list[str]:
        """The words that single signs and spaced runs make; only where enough of such kinds follow each other are they looked for."""
        kinds = found.kinds_of(row)
        made = ["".join(m[0].split()) for m in SPACED.finditer(found.texts[row])] if SINGLES.search(kinds) else []
        for m in RUNS.finditer(kinds):
            first = found.rows[row]
            for run in spaced_runs(found.words_at(slice(first + m.start(), first + m.end()))):
                made += self.runs[tuple(run)]
        return made


def lowered(text: str | None) -> str:
    """A text in lower case, unless that depends on the letters around or changes the number of signs."""
    text = text or ""
    return text if "\u0130" in text or "\u03a3" in text else text.lower()


class WordTable:
    """The words of some texts in lower case, in order: where they begin and end, their kinds, and which are plain.

    A plain word has nothing but letters between the marks around it (from ``left`` to ``right``) and no repetitions, so it is read as
    it is; so is one of marks alone, as nothing. All places are found at once from the signs of the texts.
    """

    def __init__(self, texts: list[str | None]):
        self.texts = [lowered(t) for t in texts]
        self.joined = "".join([t + "\n" for t in self.texts])
        self.points = points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs, size = SIGNS[np.minimum(points, len(SIGNS) - 1)], len(points)
        turns = np.flatnonzero(np.diff((signs & BLANK) > 0, prepend=True))
        self.starts, self.ends = turns[::2], turns[1::2]
        at = np.arange(size, dtype=np.int64)

        def after(mark: int) -> np.ndarray:
            return np.minimum.accumulate(np.where(signs & mark, size, at)[::-1])[::-1][self.starts]

        front, self.left = after(IN_FRONT), after(AT_EDGE)
        self.right = np.maximum.accumulate(np.where(signs & AT_EDGE, -1, at))[self.ends - 1] + 1
        kinds = np.full(len(self.starts), ord("n"), np.uint8)
        kinds[(self.right > front) & (self.right <= front + 2)] = ord("p")
        kinds[self.ends == self.starts + 1] = ord("s")
        self.kinds = kinds.tobytes().decode("ascii")
        odd = (signs & LETTER) == 0
        odd[:-2] |= (points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])
        before = np.concatenate([[0], np.cumsum(odd)])
        self.plain = before[np.maximum(self.left, self.right)] == before[self.left]
        self.rows = np.searchsorted(self.starts, np.cumsum([0, *[len(t) + 1 for t in self.texts]])).tolist()

    def firsts(self) -> np.ndarray:
        """The first ``FIRST`` signs of each word without the marks around it, as a number."""
        key, last = np.zeros(len(self.left), np.int64), len(self.points) - 1
        for k in range(FIRST):
            point = self.points[np.minimum(self.left + k, last)].astype(np.int64)
            key |= np.where(self.left + k < self.right, point, 0) << (21 * k)
        return key

    def words_at(self, places: np.ndarray | slice) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.starts[places].tolist(), self.ends[places].tolist())]

    def words_of(self, row: int) -> list[str]:
        return self.texts[row].split()

    def kinds_of(self, row: int) -> str:
        return self.kinds[self.rows[row] : self.rows[row + 1]]


def key_of(begin: str) -> int:
    """The number of the first signs of a word, as ``WordTable.firsts`` gives it."""
    return sum(ord(c) << (21 * k) for k, c in enumerate(begin[:FIRST]))


def word_tables(texts: list[str | None]) -> Iterator[WordTable]:
    """Tables of the words of all texts, each of about ``BLOCK_SIGNS`` signs or of one text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text or "") > BLOCK_SIGNS:
            yield WordTable(block)
            block, size = [], 0
        block.append(text)
        size += len(text or "")
    if block:
        yield WordTable(block)


def spaced_runs(words: list[str]) -> Iterator[list[tuple[str, bool]]]:
    """Runs of three or more words of one or two signs: the signs, and whether a mark before them or after the last ones is an edge."""
    run: list[tuple[str, bool]] = []
    edge = False
    for word in [*words, "..."]:
        bare = word.lstrip(FRONT)
        core = bare.rstrip(EDGE)
        if 0 < len(core) <= 2:
            run.append((core, edge or len(bare) < len(word)))
            edge = len(core) < len(bare)
        elif len(word) == 1:
            # a mark set apart can be a letter's look-alike
            run.append((word, edge))
            edge = False
        else:
            if len(run) > 2 and any(map(str.isalpha, "".join(piece for piece, _ in run))):
                yield run
            run, edge = [], False


def word_costs(texts: DataFrame) -> dict[str, float]:
    """Costs in nats of the most frequent ``LEXICON`` words of the texts."""

    def stripped(found: Counter) -> pa.RecordBatch:
        total = Counter()
        for word, n in found.items():
            total[word.strip(EDGE)] += n
        names = [w for w in total if w and PLAIN.fullmatch(w)]
        return pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "n": pa.array([total[w] for w in names], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                    found.update((text or "").lower().split())
                    if len(found) >= COUNT_WORDS:
                        yield stripped(found)
                        found.clear()
        yield stripped(found)

    counted = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    total = sum(r["n"] for r in rows)
    return {r["word"]: math.log(total / r["n"]) for r in rows}


def model_of(cost: np.ndarray, words: dict[str, float]) -> LetterModel:
    """A letter model in a task, from what was sent to it."""
    model = LetterModel.__new__(LetterModel)
    model.keep(cost, words)
    return model


def with_restored(df: DataFrame, model: LetterModel, text: str = "text", restored: str = "restored") -> DataFrame:
    """Add the restored text."""
    shared = df.sparkSession.sparkContext.broadcast((model.cost, model.words))

    def make():
        letters = model_of(*shared.value)
        return lambda texts: [[letters.restore(t) for t in texts]]

    return with_arrow(df, [text], T.StructType([T.StructField(restored, T.StringType())]), make)


def word_features(word: str) -> list[str]:
    """A restored word and its beginnings of 3 to 8 letters."""
    return [word, *[word[:n] + "*" for n in range(FIRST, LAST + 1) if len(word) > n]]


def feature_counts(words: list[str], rows: list[np.ndarray], marks: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Every feature of the different ``words`` with the numbers of rows that have it, marked and unmarked; a row holds places of words.

    Words are put in order, so that those with a common beginning follow each other within a row and are counted once.
    """
    size = len(words)
    if not size:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = sorted(range(size), key=words.__getitem__)
    names = [words[k] for k in order]
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row, word = np.divmod(np.sort(row * size + rank[np.concatenate(rows)], kind="stable"), size)
    marked = np.array(marks, bool)[row]
    lengths = np.array([len(w) for w in names])
    heads = np.array([w[:LAST] for w in names], f"U{LAST}").view(np.uint32).reshape(size, LAST)
    # of neighbours in the order, whether the first signs up to each place are the same
    same = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1)
    found, ones, every = list(names), [np.bincount(word[marked], minlength=size)], [np.bincount(word, minlength=size)]
    for n in range(FIRST, LAST + 1):
        group = np.concatenate([[0], np.cumsum(~same[:, n - 1])])
        longer = np.flatnonzero(lengths > n)
        kept = lengths[word] > n
        r, g, y = row[kept], group[word[kept]], marked[kept]
        once = np.ones(len(r), bool)
        once[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        g, y = g[once], y[once]
        at, first = np.unique(group[longer], return_index=True)
        found += [names[k][:n] + "*" for k in longer[first]]
        ones.append(np.bincount(g[y], minlength=size)[at])
        every.append(np.bincount(g, minlength=size)[at])
    one = np.concatenate(ones)
    return found, one, np.concatenate(every) - one


def restored_words(letters: LetterModel, read: Remembered, texts: list[str | None]) -> Iterator[set[str]]:
    """The different restored words of each text; ``read`` remembers those that are not read as they stand."""
    for table in word_tables(texts):
        clean = table.plain & (table.left == table.starts) & (table.right == table.ends)
        as_they_are, others = clean.tobytes(), (~clean).tobytes()
        for row, (first, end) in enumerate(zip(table.rows, table.rows[1:])):
            words = table.words_of(row)
            found = set(compress(words, as_they_are[first:end]))
            found.update(map(read.__getitem__, compress(words, others[first:end])))
            found.update(map(read.__getitem__, letters.made_words(table, row)))
            found.discard("")
            yield found


class ToxicityModel:
    def __init__(self, letters: LetterModel, intercept: float, weights: dict[str, float]):
        self.letters, self.intercept, self.weights = letters, intercept, weights


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", features: int = 1000, penalty: float = 0.004) -> ToxicityModel:
    """Letter model over all documents; words, features and weights from all labelled ones outside the held-out fold.

    The restored words of the labelled documents are written once. The ``features`` restored words and beginnings that mark label 1
    best are counted on Spark, and so are the sums that the weights are fitted by. The weight of the absolute penalty is
    ``penalty * sqrt(log(features) / rows)``, as the noise of a weight falls with the rows.
    """
    letters = LetterModel(letter_counts(docs))
    known = labelled(labels, label, fold(4, 2))
    known = F.broadcast(known) if at_most(known, LABEL_ROWS) else known.hint("merge")
    marked = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~fold(4, 2)).join(known, "doc_id").select("label", "text")
    letters.words = word_costs(marked)
    shared = docs.sparkSession.sparkContext.broadcast((letters.cost, letters.words))

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(*shared.value)
        read = Remembered(model.restore_word)
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(start, COUNT_ROWS)
                words = [" ".join(sorted(found)) for found in restored_words(model, read, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.string())], names=["label", "words"])

    rows = cut_lineage(marked.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(restore, "label int, words string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: defaultdict[str, int] = defaultdict()
        places.default_factory = places.__len__
        held, marks, size = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, COUNT_ROWS):
                part = batch.slice(start, COUNT_ROWS)
                for y, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = words.split()
                    held.append(np.fromiter(map(places.__getitem__, found), np.int64, len(found)))
                    marks.append(y > 0)
                    size += len(found)
                    if size >= FEATURE_WORDS:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, feature_counts(list(places), held, marks))), names=["feature", "ones", "zeros"])
                        places.clear()
                        held, marks, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, feature_counts(list(places), held, marks))), names=["feature", "ones", "zeros"])

    totals = rows.agg(F.sum((F.col("label") > 0).cast("long")), F.count("*")).first()
    n1, n = totals[0] or 0, totals[1]
    share = F.log(((F.col("ones") + 0.5) / (n1 + 1)) / ((F.col("zeros") + 0.5) / (n - n1 + 1)))
    counted = rows.mapInArrow(count, "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    best = counted.where("ones >= 3").withColumn("gain", F.col("ones") * share).where("gain > 0").orderBy(F.desc("gain"), "feature").limit(features)
    names = [r["feature"] for r in best.select("feature").collect()]
    if not names:
        share_of_ones = (n1 + 0.5) / (n + 1)
        return ToxicityModel(letters, math.log(share_of_ones / (1 - share_of_ones)), {})
    place = {f: k for k, f in enumerate(names)}
    # a word whose first letters begin no feature has none
    begins = {f[:FIRST] for f in names}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Remembered(lambda word: [place[f] for f in word_features(word) if f in place] if word[:FIRST] in begins else [])
        for batch in batches:
            has = [sorted(set(chain.from_iterable(map(places.__getitem__, words.split())))) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(has, pa.list_(pa.int32()))], names=["label", "has"])

    sets = rows.mapInArrow(look_up, "label int, has array<int>").groupBy("label", "has").agg(F.count("*").alias("w"))
    sets = cut_lineage(sets.coalesce(max(1, n // FIT_ROWS)))
    intercept, weights = fit_sparse_lasso(sets, len(names), penalty * math.sqrt(math.log(len(names) + 1) / max(1, n)))
    return ToxicityModel(letters, intercept, {f: float(w) for f, w in zip(names, weights) if w})


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each whole text; an empty or null text scores as one without any marking word."""
    shared = df.sparkSession.sparkContext.broadcast((model.letters.cost, model.letters.words, model.intercept, model.weights))

    def make():
        cost, words, intercept, weights = shared.value
        letters = model_of(cost, words)
        # a plain word whose first letters begin no weighted feature has none; of the others what has a weight is remembered
        begins = np.array(sorted({key_of(f) for f in weights}), np.int64)
        features = Remembered(lambda word: tuple(f for f in word_features(letters.restore_word(word)) if f in weights))

        def score_of(words: set[str]) -> float:
            # a feature counts once per document
            found = set(chain.from_iterable(map(features.__getitem__, words)))
            total = intercept + sum(weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))

        def scores_of(texts: list[str | None]) -> list[list[float]]:
            out = []
            for table in word_tables(texts):
                places = np.flatnonzero(~table.plain | np.isin(table.firsts(), begins))
                words = table.words_at(places)
                cuts = np.searchsorted(places, table.rows).tolist()
                out += [score_of({*words[a:b], *letters.made_words(table, row)}) for row, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            return [out]

        return scores_of

    return with_arrow(df, [text], T.StructType([T.StructField(score, T.DoubleType())]), make)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """Score every whole text. Without labels every score is 1/2; repeated rows are scored alike."""
    scored = with_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", fold(4, 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
