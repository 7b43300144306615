"""Principal components, one-hot SVD and multiple correspondence analysis.

Spark computes the cross products; only matrices of (columns x columns), of a few axes, or of at most
``DENSE_CATEGORIES`` squared reach the driver. Scoring is a projection with literal matrices or a join with the category table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrows.functions.columns import squared_error, total
from oddrows.models.common import assembled
from oddrows.session import cut_lineage, small_join

DENSE_CATEGORIES = 1000  # up to here all category pairs are solved at once; more are iterated on Spark


@dataclass
class Components:
    cols: list[str]
    mean: np.ndarray
    axes: np.ndarray  # k x columns, orthonormal rows, largest loading positive
    ratio: np.ndarray  # explained variance ratio


def _signed(axes: np.ndarray) -> np.ndarray:
    lead = np.abs(axes).argmax(axis=1)
    return axes * np.where(axes[np.arange(len(axes)), lead] < 0, -1.0, 1.0)[:, None]


def pca_fit(df: DataFrame, cols: Sequence[str], k: int) -> Components:
    cols = list(cols)
    vec = assembled(df.select(*cols), cols)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(vec)
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return Components(cols, np.array([row[c] for c in cols]), _signed(model.pc.toArray().T), model.explainedVariance.toArray())


def pca_transform(df: DataFrame, model: Components, prefix: str = "pc_") -> DataFrame:
    """Centre and project: columns ``pc_0 ..``."""
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(model.cols, model.mean)]
    return df.withColumns(
        {f"{prefix}{i}": total([x * F.lit(float(v)) for x, v in zip(centred, axis)]) for i, axis in enumerate(model.axes)}
    )


def reconstructed(model: Components, prefix: str = "pc_"):
    """Columns back in the original space, from the projected ones."""
    return [
        total([F.lit(float(m)), *[F.col(f"{prefix}{i}") * F.lit(float(axis[j])) for i, axis in enumerate(model.axes)]])
        for j, m in enumerate(model.mean)
    ]


def pca_inverse(df: DataFrame, model: Components, prefix: str = "pc_") -> DataFrame:
    return df.withColumns(dict(zip(model.cols, reconstructed(model, prefix))))


def pca_score(df: DataFrame, model: Components, out: str = "reconstruction_error") -> DataFrame:
    """Row sum of squared differences between a row and its reconstruction."""
    projected = pca_transform(df, model, "_pc")
    err = squared_error([F.col(c) for c in model.cols], reconstructed(model, "_pc"))
    return projected.withColumn(out, err).drop(*[f"_pc{i}" for i in range(len(model.axes))])


def pca_loadings(spark, model: Components, top: int = 5) -> DataFrame:
    """Strongest signed loadings per component (a frame of components x columns)."""
    rows = []
    for i, axis in enumerate(model.axes):
        order = sorted(range(len(axis)), key=lambda j: (-abs(axis[j]), model.cols[j]))[:top]
        rows += [(i, r + 1, model.cols[j], float(axis[j]), float(model.ratio[i])) for r, j in enumerate(order)]
    return spark.createDataFrame(rows, "component int, rank int, feature string, loading double, variance_ratio double")


def pca_importance(spark, model: Components) -> DataFrame:
    sums = np.abs(model.axes).sum(axis=0)
    return spark.createDataFrame([(c, float(s)) for c, s in zip(model.cols, sums)], "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def center_contribution(spark, model: Components, center: Sequence[float]) -> DataFrame:
    """How each original feature contributes to a centre given in component space."""
    weight = np.asarray(center, dtype=float) @ model.axes
    rows = [(c, float(w), float(abs(w))) for c, w in zip(model.cols, weight)]
    return spark.createDataFrame(rows, "feature string, contribution double, importance double").orderBy(F.desc("importance"), "feature")


# --- categories ----------------------------------------------------------------------------------


@dataclass
class Categories:
    cols: list[str]
    table: DataFrame  # c, v (column and value), coords: what a category adds to a row's coordinates
    inertia: np.ndarray  # eigenvalues, largest first


def _combinations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct combinations of the columns (null as empty text) and their rows ``n``."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]
    return df.select(*text).groupBy(*cols).agg(F.count("*").alias("n"))


def _items(cols: Sequence[str]):
    return F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])


def _eigen(matrix: np.ndarray, k: int):
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return values[order], _signed(vectors[:, order].T).T


def _dense(combos: DataFrame, sizes: DataFrame, cols: Sequence[str], k: int, scaled: bool) -> tuple[DataFrame, np.ndarray]:
    """Axes from the table of all category pairs: (c, v, n, axes), eigenvalues."""
    spark, m = combos.sparkSession, len(cols)
    found = sizes.orderBy("c", "v").collect()
    order = {(r["c"], r["v"]): i for i, r in enumerate(found)}
    pairs = combos.select("n", F.explode(_items(cols)).alias("a"), _items(cols).alias("all")).select("n", "a", F.explode("all").alias("b"))
    burt = np.zeros((len(order), len(order)))
    for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        burt[order[r["a"]["c"], r["a"]["v"]], order[r["b"]["c"], r["b"]["v"]]] = r["n"]
    if scaled:
        n = np.diag(burt).sum() / m
        root = np.sqrt(np.diag(burt) / (n * m))
        burt = burt / (n * m * m) / np.outer(root, root) - np.outer(root, root)
    values, vectors = _eigen(burt, k)
    rows = [(r["c"], r["v"], r["n"], vectors[i].tolist()) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "c string, v string, n long, axes array<double>"), values


def _iterated(combos: DataFrame, sizes: DataFrame, cols: Sequence[str], k: int, scaled: bool, rounds: int = 100, tol: float = 1e-10):
    """The same axes by subspace iteration, for any number of categories.

    A block of vectors over the categories is multiplied by the pair counts without forming them: every combination sums the
    vectors of its categories, and categories sum what their combinations found. Only the products of the block with itself
    reach the driver. Stops when the eigenvalues have settled.
    """
    m = len(cols)
    total = combos.agg(F.sum("n")).first()[0]
    width = k + 10
    numbered = cut_lineage(combos.select(F.monotonically_increasing_id().alias("row"), "n", _items(cols).alias("items")))
    cells = cut_lineage(numbered.select("row", "n", F.explode("items").alias("item")).select("row", "n", "item.c", "item.v").repartition("row"))
    # scaling of a category before and after the product; ``root`` is the axis that carries no inertia
    scale = F.sqrt(F.lit(float(total * m)) / F.col("size")) / (m * math.sqrt(total)) if scaled else F.lit(1.0)
    root = F.sqrt(F.col("size") / (total * m)) if scaled else F.lit(0.0)
    names = [f"w{i}" for i in range(width)]
    start = [(F.pmod(F.xxhash64("c", "v", F.lit(i)), F.lit(2**31)) / 2**31 - 0.5).alias(f"w{i}") for i in range(width)]
    block = cut_lineage(sizes.select("c", "v", F.col("n").alias("size")).select("c", "v", "size", scale.alias("scale"), root.alias("root"), *start))
    previous = None
    for _ in range(rounds):
        # products of the block, with the idle axis taken out
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = block.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col("root") * F.col(c)).alias(f"r{i}") for i, c in enumerate(names)]).first()
        gram = np.zeros((len(names),) * 2)
        for i, j in pairs:
            gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
        idle = np.array([sums[f"r{i}"] for i in range(len(names))])
        values, turn = np.linalg.eigh(gram - np.outer(idle, idle))
        live = np.argsort(values)[::-1]
        live = live[values[live] > 1e-22 * values.max()]
        turn = turn[:, live] / np.sqrt(values[live])
        found = np.sqrt(values[live])[:k]
        names = names[: len(live)]
        freed = [F.col(f"w{i}") - F.col("root") * float(idle[i]) for i in range(len(idle))]
        block = block.select("c", "v", "size", "scale", "root", *[total_of(freed, turn[:, j]).alias(c) for j, c in enumerate(names)])
        if previous is not None and len(found) == len(previous) and np.abs(found - previous).max() <= tol * found[0]:
            break
        previous = found
        own = block.select("c", "v", *[(F.col(c) * F.col("scale")).alias(c) for c in names])
        rows = Window.partitionBy("row")  # one row per column of the table
        met = small_join(cells, own, ["c", "v"], "inner").select("n", "c", "v", *[F.sum(c).over(rows).alias(c) for c in names])
        back = met.groupBy("c", "v").agg(*[F.sum(F.col("n") * F.col(c)).alias(f"_{c}") for c in names])
        block = cut_lineage(block.drop(*names).join(back, ["c", "v"]).select("c", "v", "size", "scale", "root", *[(F.col(f"_{c}") * F.col("scale")).alias(c) for c in names]))
    names = names[:k]
    block = cut_lineage(block)
    lead = block.agg(*[F.max_by(c, F.struct(F.abs(F.col(c)), "c", "v")).alias(c) for c in names]).first()
    signed = F.array(*[F.col(c) * (-1.0 if lead[c] < 0 else 1.0) for c in names])
    return block.select("c", "v", F.col("size").alias("n"), signed.alias("axes")), found


def total_of(parts, weights):
    return total([p * F.lit(float(w)) for p, w in zip(parts, weights)])


def _category_axes(df: DataFrame, cols: Sequence[str], k: int, scaled: bool, dense: int):
    combos = cut_lineage(_combinations(df, cols))
    sizes = cut_lineage(combos.select("n", F.explode(_items(cols)).alias("i")).groupBy("i.c", "i.v").agg(F.sum("n").alias("n")))
    count = sizes.count()
    k = max(1, min(k, count - len(cols))) if scaled else min(k, count)  # the others carry no inertia
    table, values = (_dense if count <= dense else _iterated)(combos, sizes, cols, k, scaled)
    return table, values, combos


def onehot_svd_fit(df: DataFrame, cols: Sequence[str], k: int = 15, dense: int = DENSE_CATEGORIES) -> Categories:
    """Truncated SVD of the one-hot matrix; a row's coordinates are its categories' right singular rows.

    Up to ``dense`` categories are solved from their pair counts, more by subspace iteration on Spark.
    """
    table, values, _ = _category_axes(df, cols, k, False, dense)
    return Categories(list(cols), table.select("c", "v", F.col("axes").alias("coords")), values)


def mca_fit(df: DataFrame, cols: Sequence[str], k: int, dense: int = DENSE_CATEGORIES) -> Categories:
    """Correspondence analysis of the indicator matrix: principal row coordinates and principal inertias (``dense`` as in ``onehot_svd_fit``)."""
    table, values, combos = _category_axes(df, cols, k, True, dense)
    m = len(cols)
    rows = combos.agg(F.sum("n")).first()[0] or 0
    root = F.sqrt(F.col("n") / float(rows * m))
    return Categories(list(cols), table.select("c", "v", F.transform("axes", lambda x: x / root / m).alias("coords")), values)


def category_coordinates(df: DataFrame, model: Categories, prefix: str) -> DataFrame:
    """Row coordinates ``<prefix>0 ..``: sum of the coordinates of the row's categories; unseen add 0."""
    out = df
    for j, c in enumerate(model.cols):
        lookup = model.table.filter(F.col("c") == c).select(F.col("v").alias(f"_v{j}"), F.col("coords").alias(f"_w{j}"))
        keyed = out.withColumn(f"_v{j}", F.coalesce(F.col(c).cast("string"), F.lit("")))
        out = small_join(keyed, lookup, f"_v{j}").drop(f"_v{j}")
    parts = {
        f"{prefix}{i}": total([F.coalesce(F.get(F.col(f"_w{j}"), F.lit(i)), F.lit(0.0)) for j in range(len(model.cols))]) for i in range(len(model.inertia))
    }
    return out.withColumns(parts).drop(*[f"_w{j}" for j in range(len(model.cols))])


def onehot_svd(df: DataFrame, cols: Sequence[str], k: int = 15) -> DataFrame:
    return category_coordinates(df, onehot_svd_fit(df, cols, k), "onehot_SVD_")


def mca(df: DataFrame, cols: Sequence[str], k: int, prefix: str | None = None) -> DataFrame:
    return category_coordinates(df, mca_fit(df, cols, k), prefix or f"{cols[0]}_MCA_")
