"""Distance work between two point sets without cross joins and without emitting pairs.

Equal points are collapsed to one weighted point first. A function then reduces a block of query points
against a block of reference points (numpy, bounded memory) to partial results that merge by key:

* a reference set of a checked size is broadcast and each task streams its query rows past it;
* a larger one is cut into cells around pivots and cells into blocks of a few thousand rows. With a radius
  a query only visits cells the triangle inequality cannot rule out; nearest neighbours are searched in two rounds, the first
  of which finds each query its own bound. Both sides of every (cell, block, block) tile are bounded, whatever the skew;
* where all pairs are wanted, or cells rule out little (wide points), every block of one side meets every block of the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.operators.order import is_whole, key_numbers, running_totals
from oddrows.operators.sampling import sample_n
from oddrows.session import BROADCAST_ROWS, BROADCAST_ROWS_KEY, at_most, cut_lineage, setting, small_join

TILE_ROWS = 4096
CHUNK_CELLS = 4_000_000  # distance matrix entries held at once
MAX_PIVOTS = 2048
NEAR_ROWS = 1024  # rows of a cell in the search for nearest neighbours
ROUTED_ROWS = 10_000  # rows with their coordinates that a routing task hands on at once
BLOCK_ROWS = 8  # most rows of a block of all pairs, in TILE_ROWS
BLOCKS = 16  # blocks of a side that all pairs are cut into at least, where that leaves TILE_ROWS each
CHUNK_Q, CHUNK_R = 256, 2048  # a piece of the distance matrix that stays near the core
WIDE = 16  # coordinates from which distances come from matrix products
MOST_VISITED = 0.25  # share of the cells that queries visit beyond which all pairs are cheaper
PROBES = 1000  # queries that this share is estimated from; the result does not depend on it


def point(xs: Sequence[str]) -> Column:
    """The coordinates as one array (negative zero made positive), so wide points join on one key."""
    return F.array(*[F.col(x).cast("double") + 0.0 for x in xs])


def complete(xs: Sequence[str]) -> Column:
    """All coordinates are numbers, neither null nor NaN."""
    ok = F.lit(True)
    for x in xs:
        ok = ok & F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    return ok


def distinct_points(df: DataFrame, xs: Sequence[str], id_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per distinct point ``x`` (and ``extra`` values): smallest key ``pid`` and number of rows ``w``."""
    pts = df.filter(complete(xs)).select(id_col, *extra, point(xs).alias("x"))
    return pts.groupBy("x", *extra).agg(F.min(id_col).cast("long").alias("pid"), F.count("*").alias("w"))


def attach_points(df: DataFrame, points: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Give every row the columns of its distinct point ``x``."""
    return small_join(df.withColumn("x", point(xs)), points, "x", "left").drop("x")


def on_points(df: DataFrame, xs: Sequence[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Columns that ``add`` makes of the point ``_x`` alone: once for every distinct point where those are few enough to
    broadcast, else row by row."""
    limit = setting(df.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS)
    placed = df.withColumn("_x", point(xs))
    few = cut_lineage(placed.select("_x").distinct().limit(limit + 1))
    if few.count() > limit:
        return add(placed).drop("_x")
    made = add(few)
    return placed.drop(*[c for c in made.columns if c != "_x"]).join(F.broadcast(made), "_x", "left").drop("_x")


def coordinates(block: pd.DataFrame) -> np.ndarray:
    return np.stack(block["x"].to_numpy()) if len(block) else np.zeros((0, 1))


def sq_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        diff = q[:, j][:, None] - r[:, j][None, :]
        out += diff * diff
    return out


def exact_pairs(qx: np.ndarray, rx: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distances of listed pairs, summed in the order of ``sq_distances``."""
    out = np.zeros(len(row))
    for j in range(qx.shape[1]):
        diff = qx[row, j] - rx[col, j]
        out += diff * diff
    return out


def distance_chunks(qx: np.ndarray, rx: np.ndarray, near_exact: bool = True):
    """Pieces ``(i, j, squared distances, slack)`` of the matrix from row ``i`` and column ``j`` on; ``slack`` bounds their error.

    Distances of wide points come from one matrix product of centred points. With ``near_exact`` those which its rounding could
    touch (the square below 1e8 slacks) are taken from the coordinates, so a distance is off by less than 1e-10 of the norms.
    """
    d = qx.shape[1]
    if d >= WIDE and len(qx) and len(rx):
        mid = rx.mean(axis=0)
        q, r = qx - mid, rx - mid
        qn, rn = (q * q).sum(axis=1), (r * r).sum(axis=1)
        left = np.column_stack([-2 * q, qn, np.ones(len(q))])
        right = np.column_stack([r, np.ones(len(r)), rn])
    for i in range(0, len(qx), CHUNK_Q):
        for j in range(0, len(rx), CHUNK_R):
            a, b = slice(i, i + CHUNK_Q), slice(j, j + CHUNK_R)
            scale = qn[a].max() + rn[b].max() if d >= WIDE else math.inf
            if not math.isfinite(scale):
                yield i, j, sq_distances(qx[a], rx[b]), 0.0
                continue
            d2 = left[a] @ right[b].T
            slack = 8 * (d + 8) * np.finfo(float).eps * scale
            if near_exact and d2.min() < 1e8 * slack:
                row, col = np.nonzero(d2 < 1e8 * slack)
                if len(row) * 4 > d2.size:
                    d2 = sq_distances(qx[a], rx[b])
                else:
                    d2[row, col] = exact_pairs(qx[a], rx[b], row, col)
            yield i, j, d2, slack


def blockwise(
    query: DataFrame,
    ref: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: str,
    radius: float | None = None,
    chunked: bool = False,
    mirrored: bool = False,
) -> DataFrame:
    """Partial results of ``fn(query rows, reference rows, squared distances)`` over all tiles that matter.

    ``query`` has a key ``qid``; ``ref`` has ``pid`` and weight ``w``; both have the coordinates ``x``. With ``chunked``,
    ``fn(query rows, reference rows)`` runs over whole tiles and takes the distances piece by piece. With ``mirrored`` both sides
    are the same points and ``fn`` has a third argument: whether the tile also stands for the one with its sides exchanged.
    """
    spark = query.sparkSession
    limit = setting(spark, BROADCAST_ROWS_KEY, BROADCAST_ROWS)

    def reduce_block(q: pd.DataFrame, r: pd.DataFrame):
        if mirrored:
            yield fn(q, r, "_q" in q and q["_q"].iat[0] != q["_r"].iat[0])
            return
        if chunked:
            yield fn(q, r)
            return
        rx = coordinates(r)
        step = max(1, CHUNK_CELLS // max(1, len(r)))
        for i in range(0, len(q), step):
            part = q.iloc[i : i + step]
            yield fn(part, r, sq_distances(coordinates(part), rx))

    if at_most(ref, limit):
        shared = spark.sparkContext.broadcast(ref.toPandas())

        def stream(batches):
            r = shared.value
            for q in batches:
                if len(q) and len(r):
                    yield from reduce_block(q, r)

        spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        return query.repartition(spread, "qid").mapInPandas(stream, schema)
    if radius is None:
        return all_pairs(query, ref, reduce_block, schema, mirrored)
    return _tiled(query, ref, reduce_block, schema, radius)


def all_pairs(query: DataFrame, ref: DataFrame, reduce_block, schema: str, mirrored: bool = False) -> DataFrame:
    """Partial results of every block of ``query`` against every block of ``ref``; of two mirrored tiles one is enough.

    A side is sent once for each block of the other; blocks grow with it up to ``BLOCK_ROWS``, so a task's memory is bounded.
    """
    most = BLOCK_ROWS * TILE_ROWS

    def blocks(rows: int) -> int:
        return max(math.ceil(rows / most), min(BLOCKS, math.ceil(rows / TILE_ROWS)), 1)

    qb, rb = blocks(query.count()), blocks(ref.count())
    first, last = F.lit(0).cast("long"), lambda n: F.lit(n - 1).cast("long")
    q = query.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(qb)))
    r = ref.withColumn("_r", F.pmod(F.xxhash64("pid"), F.lit(rb)))
    q = q.withColumn("_r", F.explode(F.sequence(F.col("_q") if mirrored else first, last(rb))))
    r = r.withColumn("_q", F.explode(F.sequence(first, F.col("_r") if mirrored else last(qb))))
    tile = _tile(reduce_block, schema)
    return q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInPandas(tile, schema)


def _tile(reduce_block, schema: str):
    empty_cols = [c.strip().split(" ")[0] for c in schema.split(",")]

    def tile(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if not len(qp) or not len(rp):
            return pd.DataFrame({c: [] for c in empty_cols})
        return pd.concat(list(reduce_block(qp, rp)), ignore_index=True)

    return tile


@dataclass
class Cells:
    """A reference set cut into cells around pivots: its rows with ``_cell``, and per cell the pivot, radius, rows and range of weights."""

    rows: DataFrame
    ids: np.ndarray
    centers: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    light: np.ndarray
    heavy: np.ndarray


def _pieces(batches, width: int):
    step = max(1, CHUNK_CELLS // max(1, width))
    for b in batches:
        for i in range(0, len(b), step):
            yield b.iloc[i : i + step]


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def cells_of(ref: DataFrame, rows: int) -> Cells:
    """Cells of about so many rows of ``ref`` (key ``pid``, coordinates ``x``, weight ``w``), at most ``MAX_PIVOTS``."""
    wanted = min(MAX_PIVOTS, max(2, math.ceil(ref.count() / rows)))
    pivots = coordinates(sample_n(ref, "pid", wanted).select("x").toPandas())

    def assign(batches):
        for b in _pieces(batches, len(pivots)):
            d = np.sqrt(sq_distances(coordinates(b), pivots))
            yield b.assign(_cell=d.argmin(axis=1).astype("int32"), _far=d.min(axis=1))

    celled = cut_lineage(ref.mapInPandas(assign, f"{_fields(ref)}, _cell int, _far double"))
    weight = F.col("w") if "w" in ref.columns else F.lit(1)
    stats = celled.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("r"), F.min(weight).alias("light"), F.max(weight).alias("heavy")).toPandas()
    of = {c: stats[c].to_numpy() for c in ("_cell", "r", "n", "light", "heavy")}
    return Cells(celled, of["_cell"], pivots[of["_cell"]], of["r"], of["n"], of["light"].astype(float), of["heavy"].astype(float))


def routed(query: DataFrame, cells: Cells, keep: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """A row for every query and every cell that ``keep(rows, distances to the pivots)`` marks."""
    ids, centers = cells.ids, cells.centers

    def route(batches):
        for b in _pieces(batches, len(centers)):
            row, cell = np.nonzero(keep(b, np.sqrt(sq_distances(coordinates(b), centers))))
            # a wide row that visits all cells would otherwise stand there thousands of times at once
            for i in range(0, len(row), ROUTED_ROWS):
                yield b.iloc[row[i : i + ROUTED_ROWS]].assign(_cell=ids[cell[i : i + ROUTED_ROWS]].astype("int32"))

    return cut_lineage(query.mapInPandas(route, f"{_fields(query)}, _cell int"))


def met(visits: DataFrame, cells: Cells, reduce_block, schema: str, query_columns: Sequence[str], once: bool = False) -> DataFrame:
    """Partial results of the visits: both sides of a cell are cut into blocks that meet in tiles. With ``once`` a query meets one block."""
    spark = visits.sparkSession
    count = visits.groupBy("_cell").agg(F.count("*").alias("v")).toPandas().set_index("_cell")["v"].to_dict()
    plan = []
    for c, k in zip(cells.ids, cells.sizes):
        blocks = max(1, math.ceil(k / TILE_ROWS))
        plan.append((int(c), blocks, max(1, math.ceil(count.get(c, 0) / (blocks if once else 1) / TILE_ROWS))))
    blocks = F.broadcast(spark.createDataFrame(plan, "_cell int, _rb int, _qb int"))  # one row per cell, <= MAX_PIVOTS
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    own = F.pmod(F.xxhash64("qid", F.lit(1)), F.col("_rb"))
    q = visits.join(blocks, "_cell").withColumn("_q", F.pmod(F.xxhash64("qid"), F.col("_qb"))).withColumn("_r", own if once else every("_rb"))
    r = cells.rows.join(blocks, "_cell").withColumn("_r", F.pmod(F.xxhash64("pid"), F.col("_rb"))).withColumn("_q", every("_qb"))
    keys = ["_cell", "_q", "_r"]
    tile = _tile(reduce_block, schema)
    kept = [c for c in cells.rows.columns if c not in ("_cell", "_far")]
    return q.select(*query_columns, *keys).groupBy(*keys).cogroup(r.select(*kept, *keys).groupBy(*keys)).applyInPandas(tile, schema)


def _tiled(query, ref, reduce_block, schema, radius):
    cells = cells_of(ref, TILE_ROWS)
    reach = cells.reach

    def keep(b, d):
        return d - reach[None, :] <= radius * (1 + 1e-9) + 1e-12

    return met(routed(query, cells, keep), cells, reduce_block, schema, query.columns)


def pruned(cells: Cells, k: int, ward: bool):
    """Marks the cells that may hold one of the k nearest, given ``_bound``, a value that k rows do not exceed (or null).

    The measure is the squared distance, or with ``ward`` the increase of the squares within clusters when two weighted
    centres ``x``, ``w`` merge. The pivots give another bound: cells in order of their farthest row until k rows are held.
    A row of a cell is no nearer than the cell's ball, nor than the plane halfway between its pivot and the query's own.
    """
    reach, sizes, light, heavy, centers = cells.reach, cells.sizes, cells.light, cells.heavy, cells.centers
    between: list[np.ndarray] = []  # distances of the pivots, made once in a task

    def factor(b, other):
        w = b["w"].to_numpy(dtype=float)[:, None]
        return w * other[None, :] / (w + other[None, :])

    def keep(b, d):
        if not between:
            between.append(np.sqrt(sq_distances(centers, centers)))
            np.fill_diagonal(between[0], np.inf)
        own = d.argmin(axis=1)
        plane = (d**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * between[0][own])
        # rounding of the plane's place must not rule out a row
        low = np.maximum(np.maximum(0.0, d - reach[None, :]), plane * (1 - 1e-9) - 1e-12) ** 2
        high = (d + reach[None, :]) ** 2
        if ward:
            low, high = low * factor(b, light), high * factor(b, heavy)
        order = np.argsort(high, axis=1)
        held = np.cumsum(sizes[order], axis=1)
        at = np.argmax(held >= min(k, sizes.sum()), axis=1)
        bound = np.take_along_axis(high, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]
        if "_bound" in b:
            bound = np.fmin(bound, b["_bound"].to_numpy(dtype=float))
        return low <= (bound * (1 + 1e-9) + 1e-12)[:, None]

    return keep


def two_rounds(query: DataFrame, ref: DataFrame, k: int, fn: Callable, schema: str, value: str, ward: bool = False, whole: Callable | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Search by cells: a block of the home cell gives each query a bound, then it visits the cells within it.

    ``fn`` keeps the k best of a block, with their measure in the column ``value``. Returns the partial results and the visits.
    With ``whole``, which reduces blocks of all pairs, these are taken (no visits) where the bounds leave too many cells.
    """
    cells = cells_of(ref, min(NEAR_ROWS, TILE_ROWS))

    def reduce_block(q, r):
        for part in _pieces([q], len(r)):
            yield fn(part, r, sq_distances(coordinates(part), coordinates(r)))

    def home(b, d):
        return np.arange(d.shape[1])[None, :] == d.argmin(axis=1)[:, None]

    first = met(routed(query, cells, home), cells, reduce_block, schema, query.columns, once=True)
    bound = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.max(value)).alias("_bound"))
    bounded = query.join(bound, "qid", "left")
    keep = pruned(cells, k + 1 if ward else k, ward)
    if whole is not None:
        bounded = cut_lineage(bounded)
        probes = sample_n(bounded, "qid", PROBES).toPandas()
        if len(probes) and keep(probes, np.sqrt(sq_distances(coordinates(probes), cells.centers))).mean() > MOST_VISITED:
            return all_pairs(query, ref, whole, schema), None
    visits = routed(bounded, cells, keep)
    return met(visits, cells, reduce_block, schema, query.columns), visits


# --- nearest neighbours --------------------------------------------------------------------------


def _nearest_in(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """k nearest rows of ``r`` per row of ``q``. Matrix products only rule pairs out; what is kept is measured by its coordinates."""
    qx, rx, pid = coordinates(q), coordinates(r), r["pid"].to_numpy()
    rows, cols, found = [], [], []
    best: tuple[np.ndarray, ...] = ()

    def close():
        if best:
            rows.append(best[0])
            cols.append(best[1])
            found.append(best[2])

    at = -1
    for i, j, d2, slack in distance_chunks(qx, rx, near_exact=False):
        if i != at:
            close()
            at, m = i, len(d2)
            best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            bound = np.full(m, np.inf)
        limit = bound
        if d2.shape[1] > k and not np.isfinite(bound).all():
            limit = np.minimum(bound, np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)
        row, col = np.nonzero(d2 <= (limit + slack)[:, None])
        if not len(row):
            continue
        exact = exact_pairs(qx, rx, row + i, col + j)
        row, col, exact = np.concatenate([best[0], row + i]), np.concatenate([best[1], col + j]), np.concatenate([best[2], exact])
        order = np.lexsort((pid[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        start = np.searchsorted(row, np.arange(i, i + m))
        place = np.arange(len(row)) - start[row - i]
        kept = place < k
        last = place == k - 1
        bound[row[last] - i] = exact[last]
        best = (row[kept], col[kept], exact[kept])
    close()
    row, col = (np.concatenate(c) if c else np.zeros(0, int) for c in (rows, cols))
    return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "pid": pid[col], "d2": np.concatenate(found) if found else np.zeros(0)})


def _nearest_points(query: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """k nearest reference points per query point ``(qid, pid, d2)``, ties by ``pid``."""

    def fn(q, r, d2):
        pid = r["pid"].to_numpy()
        take = min(k, len(pid))
        edge = np.partition(d2, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero(d2 <= edge[:, None])
        order = np.lexsort((pid[col], d2[row, col], row))
        row, col = row[order], col[order]
        start = np.searchsorted(row, np.arange(len(d2)))
        best = np.arange(len(row)) - start[row] < take
        row, col = row[best], col[best]
        return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "pid": pid[col], "d2": d2[row, col]})

    def whole(q, r):
        yield _nearest_in(q, r, k)

    schema = "qid long, pid long, d2 double"
    small = at_most(ref, setting(query.sparkSession, BROADCAST_ROWS_KEY, BROADCAST_ROWS))
    if small:
        parts = blockwise(query, ref, lambda q, r: _nearest_in(q, r, k), schema, chunked=True)
    else:
        parts = two_rounds(query, ref, k, fn, schema, "d2", whole=whole)[0]
    w = Window.partitionBy("qid").orderBy("d2", "pid")  # k rows per tile visited
    return parts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def nearest_neighbor_assign(
    query: DataFrame, ref: DataFrame, xs: Sequence[str], id_col: str, label: str, out: str | None = None
) -> DataFrame:
    """Give each query row the label of its nearest reference row (smallest key on ties) and the distance."""
    out = out or label
    if not is_whole(ref, id_col) or not is_whole(query, id_col):
        # keys of any other type are numbered in their order
        numbered = [d.join(key_numbers(d, id_col), id_col) for d in (query, ref)]
        return nearest_neighbor_assign(*numbered, xs, "_key", label, out).drop("_key")
    points = cut_lineage(distinct_points(ref, xs, id_col))
    q = distinct_points(query, xs, id_col).select(F.col("pid").alias("qid"), "x")
    near = _nearest_points(q, points, 1)
    labels = ref.select(F.col(id_col).cast("long").alias("pid"), F.col(label).alias("_label"))
    found = near.join(labels, "pid").select("qid", F.col("_label").alias(out), F.sqrt("d2").alias("distance"))
    at_point = cut_lineage(q.join(found, "qid").drop("qid"))
    base = query.drop(out) if out in query.columns else query
    return attach_points(base, at_point, xs)


def knn_lists(df: DataFrame, xs: Sequence[str], id_col: str, k: int, label: str | None = None) -> DataFrame:
    """Per distinct point the first k + 1 rows around it by (distance, key): ``(x, near: array)``.

    A point only needs its k + 1 smallest keys, so heavily repeated points stay small.
    """
    rows = df.filter(complete(xs)).select(
        F.col(id_col).cast("long").alias("_id"), point(xs).alias("x"), *([F.col(label).alias("_label")] if label else [])
    )
    points = cut_lineage(distinct_points(df, xs, id_col))
    near = _nearest_points(points.select(F.col("pid").alias("qid"), "x"), points, k + 1)
    first = _smallest_ids(rows, k + 1)
    members = points.select("pid", "x").join(first, "x").drop("x")
    cand = near.join(members, "pid").select("qid", "d2", F.inline("members"))
    w = Window.partitionBy("qid").orderBy("d2", "id")  # at most (k + 1)^2 rows
    top = cand.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    entry = F.struct("d2", "id", *(["label"] if label else []))
    lists = top.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    return cut_lineage(points.select(F.col("pid").alias("qid"), "x").join(lists, "qid").drop("qid"))


def _smallest_ids(rows: DataFrame, m: int) -> DataFrame:
    """m smallest keys per distinct point. Salted first, so a point holding a third of the rows is split."""
    extra = [F.col("_label").alias("label")] if "_label" in rows.columns else []
    entry = F.struct(F.col("_id").alias("id"), *extra)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(64)))
    w = Window.partitionBy("x", "_salt").orderBy("_id")
    kept = salted.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= m)
    return kept.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, m).alias("members"))


def knn_join(df: DataFrame, xs: Sequence[str], id_col: str, k: int = 10) -> DataFrame:
    """k nearest other rows per row: ``(id, neighbor, rank, distance)``."""
    if not is_whole(df, id_col):
        numbers = key_numbers(df, id_col)
        found = knn_join(df.join(numbers, id_col).select("_key", *xs), xs, "_key", k)
        back = numbers.select(F.col("_key").alias("neighbor"), F.col(id_col).alias("_name"))
        named = found.join(back, "neighbor").join(numbers, "_key")
        return named.select(id_col, F.col("_name").alias("neighbor"), "rank", "distance")
    lists = knn_lists(df, xs, id_col, k)
    rows = attach_points(df.select(id_col, *xs), lists, xs)
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col(id_col)), 1, k)
    out = rows.select(id_col, F.posexplode(others).alias("_p", "_e"))
    return out.select(
        id_col, F.col("_e.id").alias("neighbor"), (F.col("_p") + 1).alias("rank"), F.sqrt("_e.d2").alias("distance")
    )


def same_class_ratio(df: DataFrame, xs: Sequence[str], id_col: str, label: str, k: int = 10) -> DataFrame:
    """Share of neighbours with the same label; the row itself is one of the k, so k - 1 others count."""
    lists = knn_lists(df, xs, id_col, k - 1, label)
    rows = attach_points(df.select(id_col, label, *xs), lists, xs)
    others = F.slice(F.filter("near", lambda e: e["id"] != F.col(id_col)), 1, k - 1)
    hits = F.size(F.filter(others, lambda e: e["label"] == F.col(label)))
    return rows.agg((F.sum(hits) / F.sum(F.size(others))).alias("same_class_ratio"))


# --- pairwise statistics -------------------------------------------------------------------------


def pairwise_distance_stats(df: DataFrame, xs: Sequence[str], id_col: str, label: str | None = None) -> DataFrame:
    """Minimum, maximum, mean and exact median of all pair distances; with a label, the mean within each.

    Rows ``(scope, pairs, min, max, mean, median)``: scope ``all``, then one row per label (no median).
    """
    spark = df.sparkSession
    tag = [label] if label else []
    pts = cut_lineage(distinct_points(df, xs, id_col, tag))
    q = pts.withColumnRenamed("pid", "qid")

    def stats(qp, rp, twice):
        names = []
        if label:
            # rows of a label stand together on both sides
            qp, rp = (p.sort_values(label, kind="stable") for p in (qp, rp))
            ql, rl = qp[label].to_numpy(), rp[label].to_numpy()
            names = [v for v in np.intersect1d(ql, rl)]
            qs, rs = ([(np.searchsorted(c, v, "left"), np.searchsorted(c, v, "right")) for v in names] for c in (ql, rl))
        qw, rw = qp["w"].to_numpy(dtype=float), rp["w"].to_numpy(dtype=float)
        single = bool((qw == 1).all() and (rw == 1).all())
        own = _own_places(qp, rp)
        # per scope: weight, smallest, largest and sum of the distances
        total = {v: [0.0, math.inf, -math.inf, 0.0] for v in ["", *names]}
        sketch = Sketch()

        def add(scope, d, w, low, high):
            t = total[scope]
            t[0] += d.size if w is None else w.sum()
            t[1], t[2] = min(t[1], low), max(t[2], high)
            t[3] += d.sum() if w is None else (d * w).sum()

        for i, j, d2, _ in distance_chunks(coordinates(qp), coordinates(rp)):
            m, n = d2.shape
            d = np.sqrt(np.maximum(d2, 0, out=d2), out=d2)
            w = None
            same = own(i, j, m, n)
            if not single or same is not None:
                w = np.outer(qw[i : i + m], rw[j : j + n])
                if same is not None:
                    w[same] = qw[i + same[0]] * (qw[i + same[0]] - 1)
            scopes = [("", slice(0, m), slice(0, n))]
            for v, (a, b), (c, e) in zip(names, qs, rs) if label else ():
                a, b, c, e = max(a - i, 0), min(b - i, m), max(c - j, 0), min(e - j, n)
                if a < b and c < e:
                    scopes.append((v, slice(a, b), slice(c, e)))
            for v, a, c in scopes:
                part = d[a, c]
                if w is None:
                    add(v, part, None, part.min(), part.max())
                    continue
                live = w[a, c] > 0
                if live.any():
                    add(v, part, w[a, c], part[live].min(), part[live].max())
            # all distances once more, by cells of equal relative width
            sketch.add(_cell_of(d).ravel(), None if w is None else w.ravel())
        out = pd.DataFrame(
            [("all" if v == "" else str(v), -1, *t) for v, t in total.items() if t[0] > 0], columns=["scope", "cell", "n", "lo", "hi", "s"]
        )
        cells, counts = sketch.counts()
        out = pd.concat([out, pd.DataFrame({"scope": "all", "cell": cells, "n": counts, "lo": 0.0, "hi": 0.0, "s": 0.0})], ignore_index=True)
        return out.assign(n=out["n"] * 2, s=out["s"] * 2) if twice else out

    part = blockwise(q, pts, stats, "scope string, cell long, n double, lo double, hi double, s double", mirrored=True)
    summary = part.groupBy("scope", "cell").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.sum("n")).alias("mean")
    )
    found = summary.orderBy("scope", "cell").collect()  # cells of doubles, some ten thousand
    rows = [r for r in found if r["cell"] < 0]
    whole = next((r for r in rows if r["scope"] == "all"), None)
    median = _pair_median(q, pts, [(r["cell"], r["n"]) for r in found if r["cell"] >= 0]) if whole else None
    data = [(r["scope"], int(r["n"] / 2), r["lo"], r["hi"], r["mean"], median if r["scope"] == "all" else None) for r in rows]
    return spark.createDataFrame(data, "scope string, pairs long, min double, max double, mean double, median double")


CELL_BITS = 38  # low bits of a double that a cell of distances leaves open: 16384 cells an octave
DENSE_CELLS = 1 << 20  # cells that are counted in one array


def _cell_of(d: np.ndarray) -> np.ndarray:
    """Cell of non-negative doubles; their bits are in their order."""
    return np.ascontiguousarray(d, dtype=float).view(np.int64) >> CELL_BITS


class Sketch:
    """Counts by cell: an array around the first cells seen, a table for cells far from them (such as that of the distance 0)."""

    def __init__(self):
        self.base, self.dense = None, np.zeros(0)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, cell: np.ndarray, w: np.ndarray | None) -> None:
        low, high = int(cell.min()), int(cell.max())
        if high - low < DENSE_CELLS // 4 and self.base is None:
            self.base, self.dense = max(0, low - DENSE_CELLS // 2), np.zeros(DENSE_CELLS)
        if self.base is not None and self.base <= low and high < self.base + DENSE_CELLS:
            counts = np.bincount(cell - low, w)
            self.dense[low - self.base : low - self.base + len(counts)] += counts
            return
        found, place = np.unique(cell, return_inverse=True)
        self.rest.append((found, np.bincount(place, w, minlength=len(found)).astype(float)))
        if len(self.rest) > 64:
            self.rest = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(np.concatenate([c for c, _ in self.rest]), return_inverse=True)
        return found, np.bincount(place, np.concatenate([n for _, n in self.rest]), minlength=len(found))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.nonzero(self.dense)[0]
        if self.base is not None:
            self.rest.append((at + self.base, self.dense[at]))
        cells, n = self._merged() if self.rest else (np.zeros(0, np.int64), np.zeros(0))
        return cells[n > 0], n[n > 0]


def _own_places(qp: pd.DataFrame, rp: pd.DataFrame):
    """Where a piece of the distance matrix holds a point against itself: ``(rows, columns)`` or None."""
    place = pd.Series(np.arange(len(rp)), index=rp["pid"].to_numpy())
    both = pd.DataFrame({"pid": qp["qid"].to_numpy(), "row": np.arange(len(qp))}).join(place.rename("col"), on="pid", how="inner")
    row, col = both["row"].to_numpy(), both["col"].to_numpy()

    def own(i, j, m, n):
        here = (row >= i) & (row < i + m) & (col >= j) & (col < j + n)
        return (row[here] - i, col[here] - j) if here.any() else None

    return own


MEDIAN_VALUES = 50_000_000  # pairs whose distances may be listed one by one
FINER_BITS = 14  # a pass that cuts cells finer makes 2^14 of each


def _inside(q, pts, first: int, last: int, bits: int, finer: int) -> DataFrame:
    """Ordered pairs by the finer cells of the cells ``first`` to ``last``: ``(cell, d, n)`` with the least distance of the cell."""
    low, high = (np.array([c], np.int64) << bits for c in (first, last + 1))
    low, high = float(low.view(float)[0]), float(high.view(float)[0])

    def count(qp, rp, twice):
        qw, rw = qp["w"].to_numpy(dtype=float), rp["w"].to_numpy(dtype=float)
        own = _own_places(qp, rp)
        cells, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j, d2, _ in distance_chunks(coordinates(qp), coordinates(rp)):
            m, n = d2.shape
            # a little more than the cells, as the square root decides
            row, col = np.nonzero((d2 >= low * low * (1 - 1e-14)) & (d2 <= high * high * (1 + 1e-14)))
            d = np.sqrt(d2[row, col])
            inside = (d >= low) & (d < high)
            row, col, d = row[inside], col[inside], d[inside]
            w = qw[i + row] * rw[j + col]
            same = own(i, j, m, n)
            if same is not None:
                at = np.isin(row * n + col, same[0] * n + same[1])
                w[at] -= qw[i + row[at]]
            found, place = np.unique(d.view(np.int64) >> finer, return_inverse=True)
            cells.append(found)
            weights.append(np.bincount(place, w, minlength=len(found)))
        found, place = np.unique(np.concatenate(cells), return_inverse=True)
        n = np.bincount(place, np.concatenate(weights), minlength=len(found))
        keep = n > 0
        return pd.DataFrame({"cell": found[keep], "d": (found << finer).view(float)[keep], "n": n[keep] * (2 if twice else 1)})

    return blockwise(q, pts, count, "cell long, d double, n double", mirrored=True).groupBy("cell", "d").agg(F.sum("n").alias("n"))


def _pair_median(q, pts, sketch: list[tuple[int, float]]) -> float:
    """Median of the ordered pairs (equal to that of the unordered ones): the counts by cells name the cells that hold it. Passes over
    the tiles cut these finer until few enough distances are inside to be counted one by one, whatever the number of pairs."""
    n = sum(c for _, c in sketch)
    targets = [int(n // 2), int(n // 2) + 1]
    bits, below = CELL_BITS, 0.0
    while True:
        run, start, first, last, inside = 0.0, below, None, None, 0.0
        for cell, count in sketch:
            upto = start + run + count
            if first is None and upto >= targets[0]:
                first, below = cell, start + run
            if first is not None and last is None:
                inside += count
            if last is None and upto >= targets[1]:
                last = cell
            run += count
        # the rounding of a later pass may move the last distance over the edge of its cell
        last = sketch[-1][0] if last is None else last
        first = last if first is None else first
        if inside <= MEDIAN_VALUES:
            break
        finer = max(0, bits - FINER_BITS)
        if finer == 0:
            break
        counted = _inside(q, pts, first, last, bits, finer)
        sketch, bits = [(r["cell"], r["n"]) for r in counted.orderBy("cell").collect()], finer  # a few 2^FINER_BITS cells
    placed = running_totals(cut_lineage(_inside(q, pts, first, last, bits, 0).drop("cell")), "d", ["n"])
    upto = F.col("cum_n") + F.lit(below)
    got = placed.agg(*[F.min(F.when(upto >= t, F.col("d"))).alias(f"m{i}") for i, t in enumerate(targets)], F.max("d").alias("most")).first()
    return sum(got["most"] if v is None else v for v in got[:2]) / 2


def _spans(rows: pd.DataFrame, by: str):
    """Values of rows sorted by a column, the runs ``(number, from, to)`` of them within a range of rows, and the rows' weights."""
    names, starts = np.unique(rows[by].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(rows))

    def within(first: int, stop: int):
        a, e = np.searchsorted(starts, [first, stop - 1], "right") - 1
        return [(c, max(starts[c], first), min(ends[c], stop)) for c in range(a, e + 1)]

    return names, within, rows["w"].to_numpy(dtype=float)


def silhouette(df: DataFrame, xs: Sequence[str], id_col: str, cluster: str, exact: bool = True) -> DataFrame:
    """Mean silhouette, noise (-1) ignored, -1 with fewer than two clusters; and its verdict band.

    ``exact`` uses Euclidean distances between distinct points. Otherwise Spark's evaluator (squared
    distances from cluster moments, linear cost) is used.
    """
    spark = df.sparkSession
    live = df.filter(F.col(cluster) != -1)
    sizes = {r[cluster]: r["count"] for r in live.groupBy(cluster).count().collect()}
    if len(sizes) < 2:
        value = spark.range(1).select(F.lit(-1.0).alias("silhouette"))
    elif not exact:
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.feature import VectorAssembler

        vec = VectorAssembler(inputCols=list(xs), outputCol="_f").transform(live.withColumn("_c", F.col(cluster).cast("double")))
        score = ClusteringEvaluator(featuresCol="_f", predictionCol="_c").evaluate(vec)
        value = spark.range(1).select(F.lit(float(score)).alias("silhouette"))
    else:
        pts = cut_lineage(distinct_points(live, xs, id_col, [cluster]))
        q = pts.withColumnRenamed("pid", "qid")

        def sums(qp, rp, twice):
            qp, rp = (p.sort_values(cluster, kind="stable") for p in (qp, rp))
            sides = [_spans(p, cluster) for p in ((qp, rp) if twice else (rp,))]
            names, spans, w = sides[-1]
            total = np.zeros((len(qp), len(names)))
            back = np.zeros((len(rp), len(sides[0][0])))
            for i, j, d2, _ in distance_chunks(coordinates(qp), coordinates(rp)):
                d = np.sqrt(np.maximum(d2, 0, out=d2), out=d2)
                for c, a, e in spans(j, j + d.shape[1]):
                    total[i : i + len(d), c] += d[:, a - j : e - j] @ w[a:e]
                for c, a, e in sides[0][1](i, i + len(d)) if twice else ():
                    back[j : j + d.shape[1], c] += sides[0][2][a:e] @ d[a - i : e - i]
            out = [(qp["qid"], names, total)] + ([(rp["pid"], sides[0][0], back)] if twice else [])
            return pd.concat(
                [pd.DataFrame({"qid": np.repeat(key.to_numpy(), len(v)), "c": np.tile(v, len(key)), "s": t.ravel()}) for key, v, t in out], ignore_index=True
            )

        kind = df.schema[cluster].dataType.simpleString()
        per = blockwise(q, pts, sums, f"qid long, c {kind}, s double", mirrored=True).groupBy("qid", "c").agg(F.sum("s").alias("s"))
        table = spark.createDataFrame(list(sizes.items()), T.StructType([T.StructField("c", df.schema[cluster].dataType), T.StructField("n_c", T.LongType())]))
        own = pts.select(F.col("pid").alias("qid"), "w", F.col(cluster).alias("own"))
        both = small_join(per, table, "c").join(own, "qid")
        mine = F.col("c") == F.col("own")
        ab = both.groupBy("qid").agg(
            F.max("w").alias("w"),
            F.max(F.when(mine, F.col("n_c"))).alias("n_own"),
            F.max(F.when(mine, F.col("s") / (F.col("n_c") - 1))).alias("a"),
            F.min(F.when(~mine, F.col("s") / F.col("n_c"))).alias("b"),
        )
        top = F.greatest("a", "b")
        s = F.when((F.col("n_own") == 1) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
        value = ab.agg((F.sum(s * F.col("w")) / F.sum("w")).alias("silhouette"))
    v = F.col("silhouette")
    band = F.when(v > 0.5, "well separated").when(v > 0.25, "moderate").when(v > 0, "weak").otherwise("not separated")
    return value.withColumn("verdict", band)
