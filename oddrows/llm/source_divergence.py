"""Source divergence audit: how the smoothed term shares of the sources of a language differ, in exact integers.

1. Tasks count terms and documents per (lang, source, term) in dictionaries; one shuffle sums them. A term is kept in a language
   where it is in ``MIN_DOCS`` documents. A group's share of a term is 1 + floor(SCALE * (count + 5) / (total + 5 * terms)).
2. The distance of two groups sums the differences of their shares over all kept terms. Groups are rows of a sparse matrix; only
   terms that occur are stored. Rows are dealt to tiles: two blocks of about ``BLOCK`` groups and a slice of the terms by hash.
   Within a tile each group walks its terms through the term-major index and adds to a dense row of sums, one per peer, so
   no pair of postings is ever emitted; a tile sends one number per pair of groups.
3. A term missing from a group has its share at count 0, the zero baseline. All terms are first taken at the two
   baselines; terms of one group correct that against the peer's baseline, by prefix sums over sorted shares; a term that
   both have corrects both corrections, which is what the walk adds.

A language's slices follow the number of its entries, so neither a hot source (at most one entry a term) nor a hot language ends in
one task. The list of all pairs is the result and quadratic in the sources of a language by its definition.

Null text, lang and source are empty strings; repeated rows are documents of their own. A group without terms has its baseline
everywhere; a language without kept terms has distances of 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrows.llm.common import save

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
# Groups of a block, entries of a tile (about), and counters that a task holds before it sends them.
BLOCK, TILE_ENTRIES, COUNTERS = 200, 50_000, 150_000

# signs that are no letters part words; A-Z become small; bytes beyond ASCII stay
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a text (UTF-8), in order."""
    return data.translate(_FOLD).split()


def term_counts(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of each term: lang, source, term, n, docs."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (seen, within) in held.items():
                size = len(seen)
                made = [pa.array([lang] * size), pa.array([source] * size), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, pa.array([within[t] for t in seen], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                terms = terms_of(text)
                if not terms:
                    continue
                seen, within = held.setdefault((lang, source), (Counter(), Counter()))
                seen.update(terms)
                within.update(set(terms))
            if sum(len(seen) for seen, _ in held.values()) > counters:
                yield from sent()
                held.clear()
        yield from sent()

    sent = given.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """Exact smoothed share in units of 1 / SCALE."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def tile_sums(table: pa.Table) -> tuple[list[str], list[str], np.ndarray]:
    """Differences of all pairs of a tile: its rows, its peers, and the matrix of sums.

    ``table`` has a head (null term, ``p`` the baseline, ``terms`` their number in the language) for every group of the two blocks,
    and an entry for every term of the slice that a group has.
    """
    first = pc.equal(table["block"], table["a"])
    is_head = pc.is_null(table["term"])
    names = table["source"].filter(is_head).combine_chunks()
    zero = table["p"].filter(is_head).to_numpy()
    upper = first.filter(is_head).to_numpy(zero_copy_only=False)
    if table["a"][0].as_py() == table["c"][0].as_py():
        rows = peers = np.arange(len(names))
    else:
        rows, peers = np.flatnonzero(upper), np.flatnonzero(~upper)
    entries = table.filter(pc.invert(is_head))
    group = pc.index_in(entries["source"], names).to_numpy().astype(np.int64)
    share_of = entries["p"].to_numpy()
    term = pc.dictionary_encode(entries["term"].combine_chunks()).indices.to_numpy().astype(np.int64) if len(entries) else np.zeros(0, np.int64)
    whole = table["terms"][0].as_py() if table["slice"][0].as_py() == 0 else 0
    # sums of |share - x| over the terms of a group against its own baseline, for any x
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(len(names) + 1))
    own = [by_group[ends[g] : ends[g + 1]] for g in range(len(names))]

    def alone(g: int, x: np.ndarray) -> np.ndarray:
        values = np.sort(share_of[own[g]])
        sums = np.concatenate([[0], np.cumsum(values)])
        below = np.searchsorted(values, x)
        return (sums[-1] - sums[below] - x * (len(values) - below)) + (x * below - sums[below]) - len(values) * np.abs(zero[g] - x)

    place = np.full(len(names), -1)
    place[peers] = np.arange(len(peers))
    # term-major index of the peers
    listed = np.flatnonzero(place[group] >= 0)
    listed = listed[np.argsort(term[listed], kind="stable")]
    starts = np.searchsorted(term[listed], np.arange((term.max() if len(term) else -1) + 2))
    peer, peer_share = place[group[listed]], share_of[listed]
    base = zero[peers]
    out = np.zeros((len(rows), len(peers)), np.int64)
    for k, h in enumerate(peers):
        out[:, k] += alone(h, zero[rows])
    for k, g in enumerate(rows):
        sums = out[k]
        sums += alone(g, base) + whole * np.abs(zero[g] - base)
        begin = starts[term[own[g]]]
        size = starts[term[own[g]] + 1] - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        mine, theirs, low = np.repeat(share_of[own[g]], size), peer_share[at], base[peer[at]]
        both = np.abs(mine - theirs) - np.abs(mine - low) - np.abs(zero[g] - theirs) + np.abs(zero[g] - low)
        np.add.at(sums, peer[at], both)
    listed_names = names.to_pylist()
    return [listed_names[g] for g in rows], [listed_names[h] for h in peers], out


def pair_distances(entries: DataFrame, groups: DataFrame, langs: DataFrame, block: int = BLOCK, tile: int = TILE_ENTRIES) -> DataFrame:
    """Distance of each ordered pair of sources of a language: lang, source, item, value.

    ``entries`` (lang, source, term, p), ``groups`` (lang, source, zero), ``langs`` (lang, terms, groups, entries).
    """
    plan = langs.select(
        "lang", "terms", F.ceil(F.col("groups") / block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("entries") / tile)).cast("int").alias("slices")
    )
    home = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    heads = groups.join(plan, "lang").select("lang", "source", F.col("zero").alias("p"), "terms", home.alias("block"), "blocks", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    rows = entries.join(plan, "lang").select(
        "lang", "source", "p", "terms", home.alias("block"), "blocks", "term", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    )
    dealt = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("c"), "slice", "block", "source", "term", "p", "terms")

    def work(table: pa.Table) -> pa.Table:
        rows, peers, sums = tile_sums(table)
        lang = table["lang"][0].as_py()
        left, right, value = np.repeat(rows, len(peers)), np.tile(peers, len(rows)), sums.ravel()
        if table["a"][0].as_py() != table["c"][0].as_py():
            left, right, value = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([value, value])
        some = left != right
        made = [pa.array([lang] * int(some.sum()), pa.string()), pa.array(left[some], pa.string()), pa.array(right[some], pa.string()), pa.array(value[some])]
        return pa.Table.from_arrays(made, names=["lang", "source", "item", "value"])

    sums = dealt.groupBy("lang", "a", "c", "slice").applyInArrow(work, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE_ENTRIES) -> DataFrame:
    """Distances between the sources of each language (part ``pair``) and the terms that a source has above its language (part ``term``)."""
    counts = save(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).drop("docs")
    found = save(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    present = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    groups = present.join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["size", "own", "terms", "lang_size"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms"))).otherwise(0)
    groups = save(groups.withColumn("zero", zero), "groups")
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("groups"), F.sum("own").alias("entries"))
    entries = found.join(groups.select("lang", "source", "size", "terms", "lang_size"), ["lang", "source"])
    entries = entries.select("lang", "source", "term", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("terms")).alias("q"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return df.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    pairs = pair_distances(entries.select("lang", "source", "term", "p"), groups.select("lang", "source", "zero"), langs, block, tile)
    above = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS terms, sum(total) AS size FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.size, 0) + 5 * v.terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (v.size + 5 * v.terms)::HUGEINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
