"""Reproducible sampling without replacement: rows in md5 order of a seed and the key, up to exact quotas.

No rank over a whole class is ever computed. The quota-th smallest hash of each class is found as an order
statistic, and the sample is then a filter; classes that hold most of the table cost no more than others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrows.functions.columns import seeded_key, seeded_number
from oddrows.operators.order import order_statistics

_H = "_hash"


def take_quotas(df: DataFrame, id_col: str, by: Sequence[str], quotas: Callable[[dict], dict], seed: int, skip: bool = False) -> DataFrame:
    """First ``quota`` rows of each group in seeded order; ``quotas`` maps group sizes to quotas.

    Group columns are class-like (the sizes come to the driver). ``skip`` returns the other rows instead.
    """
    by = list(by)
    hashed = df.withColumn(_H, seeded_number(seed, id_col))
    asked: dict = {}

    def ranks(sizes):
        for g, q in quotas(sizes).items():
            asked[g] = min(int(q), sizes.get(g, 0))
        return {g: [q] for g, q in asked.items() if q > 0}

    keys = by or ["_all"]
    frame = hashed if by else hashed.withColumn("_all", F.lit(0))
    found = {tuple(r[k] for k in keys): r for r in order_statistics(frame, _H, ranks, keys).collect()}
    fields = [T.StructField(k, frame.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("_cut", T.LongType()), T.StructField("_left", T.LongType())])
    table, tied = [], False
    for g, q in asked.items():
        row = found.get(g)
        if row is None and q > 0:
            raise RuntimeError(f"no cut found for group {g}")
        if row is not None:
            left = q - row["below"]  # rows to take among those equal to the cut (hash collisions)
            tied |= left < row["equal"]
            table.append((*g, row["value"], left))
    cuts = F.broadcast(df.sparkSession.createDataFrame(table, schema))  # one row per group
    joined = frame.join(cuts, keys, "left")
    if tied:
        w = Window.partitionBy(*keys, _H).orderBy(seeded_key(seed, id_col), id_col)
        edge = F.when(F.col(_H) == F.col("_cut"), F.row_number().over(w) <= F.col("_left")).otherwise(F.lit(False))
        chosen = F.coalesce((F.col(_H) < F.col("_cut")) | edge, F.lit(False))
        joined = joined.withColumn("_take", chosen)
        return joined.filter(~F.col("_take") if skip else F.col("_take")).select(*df.columns)
    chosen = F.coalesce(F.col(_H) <= F.col("_cut"), F.lit(False))
    return joined.filter(~chosen if skip else chosen).select(*df.columns)


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return take_quotas(df, id_col, [], lambda sizes: {g: n for g in sizes}, seed)


def sample_entities(df: DataFrame, col: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct entities, then all of their rows."""
    chosen = sample_n(df.select(col).distinct(), col, n, seed)
    return df.join(chosen, col, "left_semi")


# --- quotas (arithmetic on class counts) ---------------------------------------------------------


def stratified_quotas(counts: Mapping, n: int, positive=1) -> dict:
    """Binary target: floor of the proportional share for the positives, the rest for the negatives."""
    total = sum(counts.values())
    pos = sum(c for k, c in counts.items() if k == positive)
    keep_pos = int(n * (pos / total)) if total else 0
    return {k: min(keep_pos if k == positive else n - keep_pos, c) for k, c in counts.items()}


def apportion(counts: Mapping, n: int, spread: bool = True) -> dict:
    """``n`` places in proportion to the counts. With ``spread``, whole shares and then one more each from the largest
    class down; else every class has its nearest whole share and the largest what is left."""
    total = sum(counts.values())
    ranked = sorted(counts, key=lambda k: (-counts[k], k))
    if spread:
        whole = {k: n * counts[k] // total for k in ranked}
        short = n - sum(whole.values())
        return {k: whole[k] + (place < short) for place, k in enumerate(ranked)}
    rest = {k: round(counts[k] / total * n) for k in ranked[1:]}
    return {ranked[0]: n - sum(rest.values()), **rest}


def balanced_quotas(counts: Mapping, n: int) -> dict:
    """Proportional places, unless the fewest are less than a tenth of the most: then every class first gets a tenth of ``n``
    (5 at least), if that leaves something to share. No class gives more rows than it has."""
    if not counts:
        return {}
    places = apportion(counts, n, spread=False)
    base = max(5, n // 10)
    left = n - base * len(counts)
    if 10 * min(places.values()) < max(places.values()) and left > 0:
        places = {k: base + more for k, more in apportion(counts, left).items()}
    return {k: min(counts[k], places[k]) for k in counts}


def _single(fn):
    return lambda sizes: {(k,): q for k, q in fn({g[0]: n for g, n in sizes.items()}).items()}


# --- samplers ------------------------------------------------------------------------------------


def stratified_sample(df: DataFrame, id_col: str, y: str, n: int, seed: int = 42) -> DataFrame:
    return take_quotas(df, id_col, [y], _single(lambda c: stratified_quotas(c, n)), seed)


def balanced_stratified_sample(df: DataFrame, id_col: str, y: str, n: int, seed: int = 42) -> DataFrame:
    return take_quotas(df, id_col, [y], _single(lambda c: balanced_quotas(c, n)), seed)


def disjoint_split(df: DataFrame, id_col: str, sizes: Mapping[str, int], seed: int = 42) -> DataFrame:
    """Disjoint named sets of exact sizes from one seeded order (column ``part``); other rows are left out."""
    hashed = df.withColumn(_H, seeded_number(seed, id_col))
    ends, total = {}, 0
    for name, size in sizes.items():
        total += size
        ends[name] = total

    def ranks(rows):
        n = rows.get((0,), 0)
        return {(0,): [min(e, n) for e in ends.values()]} if n else {}

    found = {r["rank"]: r for r in order_statistics(hashed, _H, ranks).collect()}
    last = max(found, default=0)
    # a tie of hashes exactly at a boundary is settled by the full key
    part = F.lit(None).cast("string")
    place = seeded_key(seed, id_col)
    for name, end in reversed(list(ends.items())):
        row = found[min(end, last)]
        inside = F.col(_H) <= F.lit(row["value"])
        if row["below"] + row["equal"] > min(end, last):
            edge = hashed.filter(F.col(_H) == row["value"]).orderBy(place, id_col).limit(min(end, last) - row["below"])
            ids = [r[0] for r in edge.select(id_col).collect()]
            inside = (F.col(_H) < F.lit(row["value"])) | F.col(id_col).isin(ids)
        part = F.when(inside, F.lit(name)).otherwise(part)
    return hashed.withColumn("part", part).filter("part is not null").drop(_H)


def train_test(df: DataFrame, id_col: str, test_frac: float, stratify: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``part`` = train / test; with ``stratify`` the test share is exact within every class."""
    by = [stratify] if stratify else []

    def quotas(sizes):
        return {g: int(n * test_frac + 0.5) for g, n in sizes.items()}

    test = take_quotas(df, id_col, by, quotas, seed).withColumn("part", F.lit("test"))
    train = take_quotas(df, id_col, by, quotas, seed, skip=True).withColumn("part", F.lit("train"))
    return train.unionByName(test)


def capped_stratified(df: DataFrame, id_col: str, y: str, cap: int, seed: int = 42) -> DataFrame:
    """A stratified subset, only if the table has more than ``cap`` rows."""
    return take_quotas(
        df, id_col, [y], _single(lambda c: stratified_quotas(c, cap) if sum(c.values()) > cap else dict(c)), seed
    )


def multi_feature_sample(df: DataFrame, id_col: str, strata: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At least one row and else a proportional number from every combination of ``strata``, trimmed or
    topped up to exactly n rows in seeded order. Rows with a null stratum only serve the top-up."""
    strata = list(strata)
    total = df.count()
    plan: dict = {}

    def quotas(sizes):
        plan.update({g: min(c, max(1, int(c / total * n))) for g, c in sizes.items() if None not in g})
        return plan

    first = take_quotas(df, id_col, strata, quotas, seed)
    taken = sum(plan.values())
    if taken > n:
        return sample_n(first, id_col, n, seed + 1)
    rest = df.join(first.select(id_col), id_col, "left_anti").select(*df.columns)
    return first.unionByName(sample_n(rest, id_col, n - taken, seed + 1)) if taken < n else first


def adjust_class_ratio(df: DataFrame, id_col: str, y: str, n: int, positive_ratio: float, seed: int = 42) -> DataFrame:
    """Exactly int(n * ratio) positives and the rest negatives; a short class repeats its rows.

    Column ``copy`` numbers the repetitions: whole rounds first, then one more in seeded order.
    """
    want = {1: int(n * positive_ratio)}
    want[0] = n - want[1]
    counts = {r[y]: r["count"] for r in df.filter(F.col(y).isin(0, 1)).groupBy(y).count().collect()}
    rounds = {k: (want[k] // counts[k] if counts.get(k) else 0) for k in want}
    part = take_quotas(
        df.filter(F.col(y).isin(0, 1)), id_col, [y], lambda sizes: {g: want[g[0]] - rounds[g[0]] * c for g, c in sizes.items()}, seed
    )
    last = part.withColumn("copy", F.when(F.col(y) == 1, rounds[1]).otherwise(rounds[0]).cast("int"))
    times = F.when(F.col(y) == 1, rounds[1]).otherwise(rounds[0])
    full = df.filter(F.col(y).isin(0, 1)).filter(times > 0)
    copies = full.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return copies.unionByName(last)


def sample_report(original: DataFrame, sample: DataFrame, y: str) -> DataFrame:
    """Rows and percentage per class before and after sampling."""
    from oddrows.operators.joins import union_classes

    return union_classes(original, sample, y).withColumnsRenamed(
        {"n_a": "n_original", "percent_a": "percent_original", "n_b": "n_sample", "percent_b": "percent_sample"}
    )


def repeat_samples(df: DataFrame, id_col: str, y: str, n: int, repeats: int, measure: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """``measure(sample)`` for stratified samples with seeds seed, seed + 1, ...; column ``repeat`` tells them apart."""
    out = None
    for r in range(repeats):
        row = measure(stratified_sample(df, id_col, y, n, seed + r)).withColumn("repeat", F.lit(r))
        out = row if out is None else out.unionByName(row)
    return out
