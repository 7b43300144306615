"""Exact global order on distributed data: running totals, order statistics, quantiles, row index.

Spark's window without ``partitionBy`` and its exact ``percentile`` both bring a whole column to one
task. Everything here first narrows or splits the value range, so a task only sees a bounded slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.session import TASK_ROWS, TASK_ROWS_KEY, cut_lineage, setting

SKETCH_ACCURACY = 10_000
# Ranks that are bracketed together; their brackets hold less than half of the rows.
RANKS_AT_ONCE = 200


def range_bounds(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    """Split points that cut ``col`` into about equally filled ranges (exactness does not depend on them)."""
    if parts is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) * 4
    parts = max(8, min(parts, SKETCH_ACCURACY - 2_000))
    probs = [i / parts for i in range(1, parts)]
    picked = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, SKETCH_ACCURACY)).first()[0] or []
    return sorted({float(b) for b in picked if b is not None and not math.isnan(b)})


def with_range(df: DataFrame, col: str, bounds: Sequence[float], out: str) -> DataFrame:
    """Number of the range each value lies in (left-closed, binary search in the JVM)."""
    if not bounds:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *bounds, math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(col, F.col(col).cast("double"))
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` for each column of ``sums``: total over rows up to and including this one.

    ``df`` holds one row per (``by``, ``order``) value. Ranges of the order column get their totals
    first; the totals of earlier ranges (a few thousand rows) are broadcast back as offsets and the
    rest of the sum runs inside each range, so no task sees more than its own range.
    """
    by = list(by)
    if bounds is None:
        bounds = range_bounds(df, order)
    ranged = with_range(df, order, bounds, "_range")
    direction = F.desc if descending else F.asc
    per_range = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # offsets: at most (number of by-groups) x (number of ranges <= 8000) rows
    joined = ranged.join(F.broadcast(offsets), [*by, "_range"])
    out = joined.select(
        *df.columns, *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums]
    )
    return out


def order_statistics(
    df: DataFrame,
    col: str,
    ranks: Callable[[dict], dict],
    by: Sequence[str] = (),
) -> DataFrame:
    """Values at exact 1-based ranks: rows ``(*by, rank, value, below, equal)``.

    ``ranks`` maps the group sizes ``{group tuple: rows}`` to ``{group tuple: [rank, ...]}``; groups are
    classes, features and the like, so both stay small. Nulls are ignored. On more rows than one task may
    hold, a quantile sketch (rank error 1/10000) brackets every target and only values inside a bracket
    are counted one by one; the brackets narrow again until they fit.
    """
    spark = df.sparkSession
    if not by:
        return order_statistics(df.withColumn("_all", F.lit(0)), col, ranks, ["_all"]).drop("_all")
    by = list(by)
    df = df.select(*by, F.col(col).alias("_v"))
    data = df.filter(F.col("_v").isNotNull())
    sizes = {tuple(r[b] for b in by): r["_n"] for r in data.groupBy(*by).agg(F.count("*").alias("_n")).collect()}
    targets = {g: sorted(set(t)) for g, t in ranks(sizes).items() if t}
    value_type = data.schema["_v"].dataType
    key_fields = [T.StructField(b, df.schema[b].dataType) for b in by]
    target_schema = T.StructType([*key_fields, T.StructField("rank", T.LongType())])
    wanted = spark.createDataFrame([(*g, int(t)) for g, ts in targets.items() for t in ts], target_schema)
    limit = max(setting(spark, TASK_ROWS_KEY, TASK_ROWS), 2)
    inside_rows = max(sizes.values(), default=0)
    most = max((len(t) for t in targets.values()), default=0)
    if inside_rows > limit and most > RANKS_AT_ONCE:
        # brackets of too many ranks would cover the whole range: a part of the ranks at a time
        found = None
        for k in range(0, most, RANKS_AT_ONCE):
            some = {g: t[k : k + RANKS_AT_ONCE] for g, t in targets.items() if t[k : k + RANKS_AT_ONCE]}
            part = order_statistics(df, "_v", lambda _, some=some: some, by)
            found = part if found is None else found.unionByName(part)
        return found
    brackets = None
    while inside_rows > limit:
        brackets = _brackets(data, by, sizes, targets, brackets)
        inside_rows = int(inside_rows * 12 / SKETCH_ACCURACY) * max(len(t) for t in targets.values())
    if brackets is None:
        counted = data.groupBy(*by, "_v").agg(F.count("*").alias("_n")).withColumn("_zone", F.lit(1))
    else:
        counted = _count_inside(data, by, brackets, key_fields, value_type)
    w = Window.partitionBy(*by).orderBy("_zone", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_upto", F.sum("_n").over(w)).withColumn("_below", F.col("_upto") - F.col("_n"))
    hit = (F.col("_below") < F.col("rank")) & (F.col("rank") <= F.col("_upto"))
    joined = placed.join(F.broadcast(wanted), by).filter(hit)
    # a rank in a gap between brackets has no value: the sketch was further off than it promises
    value = F.coalesce(F.col("_v"), F.raise_error(F.lit("a rank lies outside of its bracket")).cast(value_type))
    return joined.select(*by, "rank", value.alias("value"), F.col("_below").alias("below"), F.col("_n").alias("equal"))


def _null_safe(by, group):
    cond = F.lit(True)
    for b, v in zip(by, group):
        cond = cond & F.col(b).eqNullSafe(F.lit(v))
    return cond


def _widened(lo, hi):
    """The sketch works on doubles, so large whole numbers come back rounded."""
    if isinstance(lo, int):
        return lo - (abs(lo) >> 50), hi + (abs(hi) >> 50)
    return lo, hi


def _brackets(data, by, sizes, targets, previous):
    """Bracket every target rank by two sketch quantiles; ``previous`` brackets restrict the sketch."""
    slack = 4 / SKETCH_ACCURACY
    if previous is None:
        probs = {
            g: [min(1.0, max(0.0, (t - 1) / max(1, sizes[g] - 1) + s)) for t in ts for s in (-slack, slack)]
            for g, ts in targets.items()
        }
        every = sorted({p for ps in probs.values() for p in ps})
        rows = data.groupBy(*by).agg(
            F.percentile_approx("_v", every, SKETCH_ACCURACY).alias("q"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        ).collect()
        out = {}
        for r in rows:
            g = tuple(r[b] for b in by)
            at = dict(zip(every, r["q"]))
            out[g] = [
                _widened(r["lo"] if ps[0] <= slack else at[ps[0]], r["hi"] if ps[1] >= 1 - slack else at[ps[1]])
                for ps in (probs[g][i : i + 2] for i in range(0, len(probs.get(g, [])), 2))
            ]
        return out
    aggs, keys = [], []
    for g, pairs in previous.items():
        for i, (lo, hi) in enumerate(pairs):
            here = _null_safe(by, g)
            aggs.append(F.count_if(here & (F.col("_v") < F.lit(lo))).alias(f"b{len(keys)}"))
            aggs.append(F.count_if(here & F.col("_v").between(F.lit(lo), F.lit(hi))).alias(f"n{len(keys)}"))
            keys.append((g, i, lo, hi))
    counts = data.agg(*aggs).first()
    sketches = []
    for j, (g, i, lo, hi) in enumerate(keys):
        p = (targets[g][i] - 1 - counts[f"b{j}"]) / max(1, counts[f"n{j}"] - 1)
        pair = [min(1.0, max(0.0, p - slack)), min(1.0, max(0.0, p + slack))]
        kept = F.when(_null_safe(by, g) & F.col("_v").between(F.lit(lo), F.lit(hi)), F.col("_v"))
        sketches.append(F.percentile_approx(kept, pair, SKETCH_ACCURACY).alias(f"q{j}"))
    got = data.agg(*sketches).first()
    out = {}
    for j, (g, i, lo, hi) in enumerate(keys):
        q, p = got[f"q{j}"], (targets[g][i] - 1 - counts[f"b{j}"]) / max(1, counts[f"n{j}"] - 1)
        inner = _widened(lo if p <= 2 * slack else q[0], hi if p >= 1 - 2 * slack else q[1])
        out.setdefault(g, []).append((max(lo, inner[0]), min(hi, inner[1])))
    return out


def _count_inside(data, by, brackets, key_fields, value_type):
    """Counts per value inside the brackets, one count per gap between them, in value order."""
    merged = []
    for g, pairs in brackets.items():
        spans: list[list] = []
        for lo, hi in sorted(pairs):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        merged.append((*g, [s[0] for s in spans], [s[1] for s in spans]))
    arr = T.ArrayType(value_type)
    schema = T.StructType([*key_fields, T.StructField("_lo", arr), T.StructField("_hi", arr)])
    table = F.broadcast(data.sparkSession.createDataFrame(merged, schema))
    joined = data.join(table, by)
    nth = F.size(F.filter("_lo", lambda s: s <= F.col("_v")))
    in_span = (nth > 0) & (F.col("_v") <= F.get("_hi", nth - 1))
    zoned = joined.select(
        *by,
        (nth * 2 + F.when(in_span, 0).otherwise(1)).alias("_zone"),
        F.when(in_span, F.col("_v")).alias("_v"),
    )
    return zoned.groupBy(*by, "_zone", "_v").agg(F.count("*").alias("_n"))


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_type: str = "double") -> DataFrame:
    """Long form ``(*keep, feature, value)`` of several columns, one pass, no shuffle."""
    cast = df.select(*keep, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return cast.unpivot(list(keep), list(cols), "feature", "value")


def column_stats(df: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``(feature, *stats)``: one wide aggregate over the table, laid out as rows afterwards."""
    aggs = [fn(F.col(f"`{c}`")).alias(f"{name}_{i}") for i, c in enumerate(cols) for name, fn in stats.items()]
    cells = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{name}_{i}").alias(name) for name in stats]) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles: rows ``(*by, feature, prob, value)``. ``by`` are class-like columns.

    Groups that fit one task use Spark's exact percentile, all columns in one aggregate if they fit together, else a
    task per column; larger ones go through :func:`order_statistics`. The result (groups x columns x probs) passes
    through the driver.
    """
    spark = df.sparkSession
    by, cols = list(by), list(cols)
    probs = [float(p) for p in probs]
    clean = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    fields = [T.StructField(k, df.schema[k].dataType) for k in by]
    schema = T.StructType(
        [*fields, T.StructField("feature", T.StringType()), T.StructField("prob", T.DoubleType()), T.StructField("value", T.DoubleType())]
    )
    sizes = clean.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    out = []
    limit = setting(spark, TASK_ROWS_KEY, TASK_ROWS)
    if sizes * len(cols) > limit >= sizes:
        for r in unpivot(clean, cols, by).groupBy(*by, "feature").agg(F.percentile("value", probs).alias("_q")).collect():
            if r["_q"] is not None:
                out += [(*[r[b] for b in by], r["feature"], p, v) for p, v in zip(probs, r["_q"])]
        return spark.createDataFrame(out, schema)
    if sizes * len(cols) <= limit:
        rows = clean.groupBy(*by).agg(*[F.percentile(c, probs).alias(f"_q{i}") for i, c in enumerate(cols)]).collect()
        for r in rows:
            for i, c in enumerate(cols):
                if r[f"_q{i}"] is not None:
                    out += [(*[r[b] for b in by], c, p, v) for p, v in zip(probs, r[f"_q{i}"])]
        return spark.createDataFrame(out, schema)
    group_rows: dict = {}

    def ranks(sizes):
        group_rows.update(sizes)
        spots = {g: [p * (n - 1) for p in probs] for g, n in sizes.items()}
        return {g: [math.floor(s) + 1 for s in ss] + [math.ceil(s) + 1 for s in ss] for g, ss in spots.items()}

    keys = [*by, "feature"]
    stats = order_statistics(unpivot(clean, cols, by), "value", ranks, keys).collect()
    at = {(*[r[k] for k in keys], r["rank"]): r["value"] for r in stats}
    for g, n in group_rows.items():
        for p in probs:
            s = p * (n - 1)
            lo, hi = at[(*g, math.floor(s) + 1)], at[(*g, math.ceil(s) + 1)]
            out.append((*g, p, lo + (hi - lo) * (s - math.floor(s))))
    return spark.createDataFrame(out, schema)


def quantile_table(df: DataFrame, cols: Sequence[str], named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """:func:`exact_quantiles` with one column per named quantile: ``(*by, feature, *names)``."""
    by = list(by)
    rows: dict = {}
    for r in exact_quantiles(df, cols, list(named.values()), by).collect():
        rows.setdefault((*[r[b] for b in by], r["feature"]), {})[r["prob"]] = r["value"]
    fields = [T.StructField(k, df.schema[k].dataType) for k in by]
    schema = T.StructType([*fields, T.StructField("feature", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in named]])
    return df.sparkSession.createDataFrame([(*k, *[v.get(float(p)) for p in named.values()]) for k, v in rows.items()], schema)


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Driver-side form of :func:`exact_quantiles` (columns x probs numbers)."""
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, cols, probs).collect()}
    return {c: [got.get((c, float(p))) for p in probs] for c in cols}


def row_index(df: DataFrame, *order: Column | str, out: str = "row_index") -> DataFrame:
    """0-based position of every row in the global order, without a single-task window.

    Range partitioning plus a sort per partition; the frame is written to the shared folder before the
    partition sizes are read, so positions stay fixed when tasks are retried.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    fixed = cut_lineage(placed)
    part = F.shiftright("_m", 33)
    sizes = fixed.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    tagged = fixed.withColumn("_p", part)
    spot = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(offsets), "_p").withColumn(out, spot).drop("_p", "_m", "_o")


def is_whole(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.IntegralType)


def key_numbers(df: DataFrame, key: str) -> DataFrame:
    """``(key, _key)``: the distinct non-null keys of any type, numbered in their order."""
    return row_index(df.select(key).where(F.col(key).isNotNull()).distinct(), key, out="_key")
