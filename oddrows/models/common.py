"""Shared parts of the fitted models: distributed sums for iterative fits, assembling, saving."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrows.operators.neighbors import distinct_points
from oddrows.session import cut_lineage


PARTIAL_SUMS = 1_000_000  # numbers of all tasks that may be added up on the driver


def assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(
        df.withColumns({c: F.col(c).cast("double") for c in cols})
    )


def training_points(df: DataFrame, xs: Sequence[str], id_col: str) -> DataFrame:
    """Distinct weighted points, written once: what an iterative fit reads every round.

    A few points need few tasks; many points get at least the session's shuffle partitions.
    """
    points = cut_lineage(distinct_points(df, xs, id_col))
    n = points.count()
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(-(-n // 20_000), max(shuffle, -(-n // 1_000_000))))
    have = points.rdd.getNumPartitions()
    return points.coalesce(parts) if parts < have else points.repartition(parts, "pid") if parts > have else points


def training_rows(rows: DataFrame) -> DataFrame:
    """Rows written once, for a fit that reads them many times, in tasks of 20,000 rows up to one for every core and
    of a million rows beyond; a table in one file would else be fitted by a task or two."""
    rows = cut_lineage(rows)
    n = rows.count()
    parts = max(min(-(-n // 20_000), rows.sparkSession.sparkContext.defaultParallelism), -(-n // 1_000_000))
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def summed(points: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Element-wise sum of ``fn(batch)`` over all rows; only ``size`` numbers reach the driver.

    Where the partial sums of all tasks are few, they are added up there without a shuffle.
    """

    def run(batches):
        acc = np.zeros(size)
        for b in batches:
            if len(b):
                acc += fn(b)
        at = np.nonzero(acc)[0]
        yield pd.DataFrame({"k": at.astype("int32"), "v": acc[at]})

    out = np.zeros(size)
    parts = points.mapInPandas(run, "k int, v double")
    if points.rdd.getNumPartitions() * size > PARTIAL_SUMS:
        parts = parts.groupBy("k").agg(F.sum("v").alias("v"))
    found = parts.toArrow()
    np.add.at(out, found["k"].to_numpy(), found["v"].to_numpy())
    return out


def save_model(spark: SparkSession, params: Mapping[str, np.ndarray], path: str) -> str:
    """Named parameter arrays as a Parquet table (pyspark.ml models have ``write().save`` instead)."""
    rows = [(k, list(np.shape(v)), np.asarray(v, dtype=float).ravel().tolist()) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
