"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of product cells; every vector lies in one. A query visits
cells by the sum of its distances to the two codewords, nearest first (the multi-sequence order), until the target recall:
the number of cells is the one at which that share of simulated neighbours, exactly at the threshold, is found. Vectors of
visited cells are verified by cosine in double precision.

The index holds every vector; only the codebooks and the number of cells come from a sample of at most ``SAMPLE`` vectors.
Equal vectors are one class from the start. A cell above ``CHUNK`` vectors is split over tasks, and queries pass through a task
in blocks. Tasks report link counts and a spanning star, never pairs. As the count of links of M close but different
vectors is asked for, all of their pairs are compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrows.llm.common import components, save

THRESHOLD, TARGET = 0.9, 0.98
# Vectors of a cell on average, of a task at most, and queries compared at a time.
CELL, CHUNK, BLOCK = 1024, 4096, 512
SAMPLE = 8192


def squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1)


def codebook(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Means of ``k`` groups of a sample."""
    codes = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = squares(x, codes).argmin(1)
        for j in np.unique(near):
            codes[j] = x[near == j].mean(0)
    return codes


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    x = values.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


class MultiIndex:
    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int):
        self.left, self.right, self.visits = left, right, visits

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest ``visits`` cells of each vector in multi-sequence order.

        With both codebooks sorted by distance, the cell at places (i, j) comes after all at lower places, so the first
        ``visits`` cells lie among those with (i + 1) * (j + 1) <= visits.
        """
        half = self.left.shape[1]
        a, b = squares(x[:, :half], self.left), squares(x[:, half:], self.right)
        order_a, order_b = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        stairs = [(i, j) for i in range(min(visits, a.shape[1])) for j in range(min(visits // (i + 1), b.shape[1]))]
        i, j = np.array(stairs).T
        cost = np.take_along_axis(a, order_a[:, i], 1) + np.take_along_axis(b, order_b[:, j], 1)
        cell = order_a[:, i] * len(self.right) + order_b[:, j]
        return np.take_along_axis(cell, np.argsort(cost, 1, kind="stable")[:, :visits], 1)


def fit_index(sample: np.ndarray, total: int, seed: int = 5) -> MultiIndex:
    """Codebooks for ``total`` vectors, and the number of cells to visit for the target recall."""
    draw = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    k = max(1, min(len(sample), round((total / CELL) ** 0.5)))
    index = MultiIndex(codebook(sample[:, :half], k, draw), codebook(sample[:, half:], k, draw), 1)
    q = sample[:1000]
    away = draw.normal(size=q.shape)
    away -= (away * q).sum(1, keepdims=True) * q
    norms = np.linalg.norm(away, axis=1, keepdims=True)
    near = THRESHOLD * q + (1 - THRESHOLD**2) ** 0.5 * away / np.where(norms == 0, 1, norms)
    home = index.cells(near, 1)[:, 0]
    a, b = squares(q[:, :half], index.left), squares(q[:, half:], index.right)
    cost = a[np.arange(len(q)), home // k] + b[np.arange(len(q)), home % k]
    visits = np.array([(x[:, None] + y[None, :] < c - 1e-12).sum() + 1 for x, y, c in zip(a, b, cost)])
    index.visits = int(np.quantile(visits, TARGET, method="higher"))
    return index


def classes_of(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct usable vectors: key, width, values, first_id, copies. Null, empty and zero vectors and those with null or non-finite components are left out."""
    v = F.col(f"`{embedding}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)
    keyed = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("values"), vector_key(v).alias("key")).where(fine)
    return keyed.groupBy("key").agg(F.first("values").alias("values"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn("width", F.size("values"))


def vector_key(v: Column) -> Column:
    # adding 0 makes a negative zero a plain one
    return F.md5(F.array_join(F.transform(v, lambda x: x + F.lit(0).cast("float")).cast("array<string>"), ","))


def links_of(classes: DataFrame) -> DataFrame:
    """Links among classes of one width: key, links (documents on the other side), tie (a class that it hangs together with)."""
    total = classes.count()
    rows = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("values").collect()
    index = fit_index(unit(np.array([r["values"] for r in rows])), total)
    book = classes.sparkSession.sparkContext.broadcast((index.left, index.right, index.visits))
    fields = "cell long, role int, key string, copies long, home long, visited array<long>, values binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = MultiIndex(*book.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                n = part.num_rows
                values = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                cells = grid.cells(unit(values), grid.visits)
                blobs = pa.array([v.tobytes() for v in values.astype(float)], pa.binary())
                homes = pa.array(cells[:, 0])
                visited = pa.array(list(cells), pa.list_(pa.int64()))
                index_rows = [homes, pa.array(np.zeros(n, np.int32)), part.column(0), part.column(1), homes, visited, blobs]
                yield pa.RecordBatch.from_arrays(index_rows, names=["cell", "role", "key", "copies", "home", "visited", "values"])
                each = pa.array(np.repeat(np.arange(n), cells.shape[1]))
                none = pa.nulls(len(each), pa.list_(pa.int64()))
                query_rows = [pa.array(cells.ravel()), pa.array(np.ones(len(each), np.int32)), part.column(0).take(each), part.column(1).take(each), homes.take(each), none, blobs.take(each)]
                yield pa.RecordBatch.from_arrays(query_rows, names=["cell", "role", "key", "copies", "home", "visited", "values"])

    placed = save(classes.select("key", "copies", "values").mapInArrow(place, fields), "cells")
    chunks = placed.where("role = 0").groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    joined = placed.join(chunks, "cell")
    own = F.pmod(F.xxhash64("key"), "chunks").cast("int")
    dealt = joined.withColumn("chunk", F.explode(F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    dealt = dealt.select("cell", "chunk", "role", "key", "copies", "home", "visited", "values").repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "role", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "links", "tie"]
        here, stored, queries = None, [], []

        def report(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=names)

        def matrix(rows):
            return unit(np.frombuffer(b"".join(r[7] for r in rows)).reshape(len(rows), -1))

        def load():
            state = {"x": matrix(stored), "label": np.arange(len(stored)), "links": np.zeros(len(stored), np.int64)}
            state["keys"] = np.array([r[3] for r in stored], object)
            state["copies"] = np.array([r[4] for r in stored])
            state["visited"] = np.array([r[6] for r in stored])
            return state

        def search(state):
            close = matrix(queries) @ state["x"].T >= THRESHOLD
            rows = []
            for q, hits in zip(queries, close):
                if not hits.any():
                    continue
                at = np.flatnonzero(hits)
                at = at[state["keys"][at] != q[3]]
                if not len(at):
                    continue
                # where the search the other way round cannot meet this pair, it is counted for both here
                alone = at[(state["visited"][at] != q[5]).all(1)]
                state["links"][alone] += q[4]
                rows.append((q[3], int(state["copies"][at].sum()), state["keys"][at[0]]))
                labels = np.unique(state["label"][at])
                if len(labels) > 1:
                    state["label"][np.isin(state["label"], labels)] = labels[0]
            return rows

        def finish(state):
            keys, label = state["keys"], state["label"]
            some = np.flatnonzero((label != np.arange(len(label))) | (state["links"] > 0))
            return [(keys[k], int(state["links"][k]), keys[label[k]]) for k in some]

        state = None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != here:
                    if state is not None:
                        made = (search(state) if queries else []) + finish(state)
                        if made:
                            yield report(made)
                    here, stored, queries, state = row[:2], [], [], None
                if row[2] == 0:
                    stored.append(row)
                    continue
                if state is None:
                    state = load()
                queries.append(row)
                if len(queries) == BLOCK:
                    made = search(state)
                    queries = []
                    if made:
                        yield report(made)
        if state is not None:
            made = (search(state) if queries else []) + finish(state)
            if made:
                yield report(made)

    return dealt.mapInArrow(compare, "key string, links long, tie string")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked to it), component_id (least id reachable by links), kept.

    Vectors link only with vectors of the same number of components. Unusable vectors are components of their own. Rows that
    repeat a vector link with each other; a null id is a vector like any other, and comes last.
    """
    classes = save(classes_of(vectors, vec_id, embedding), "classes")
    widths = [r["width"] for r in classes.select("width").distinct().orderBy("width").collect()]
    links = None
    for width in widths:
        found = links_of(classes.where(F.col("width") == width))
        links = found if links is None else links.unionByName(found)
    spark = vectors.sparkSession
    links = save(links if links is not None else spark.createDataFrame([], "key string, links long, tie string"), "links")
    joined = components(links.select(F.col("key").alias("a"), F.col("tie").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    rich = classes.select("key", "first_id", "copies").join(counts, "key", "left").join(joined, F.col("key") == F.col("node"), "left")
    rich = rich.select("key", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("part"))
    heads = rich.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = rich.join(heads, "part").select("key", "n_links", "component_id", F.lit(True).alias("usable"))
    v = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), vector_key(v).alias("key")).join(named, "key", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


# The exact links, which the index finds up to its recall.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, v.vec_id = p.component_id AS kept
FROM v JOIN parts p ON p.a = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id
"""
