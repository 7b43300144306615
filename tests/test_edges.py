import math

import pytest
from pyspark.sql import functions as F

from oddrows.operators import features as ft
from oddrows.operators import infoloss as il
from oddrows.operators import metrics as mt
from oddrows.operators import profile as pf
from oddrows.operators import sampling as sp
from oddrows.operators import stats as st
from oddrows.plans import reduction as rd
from oddrows.plans import studies as sd
from oddrows.session import scratch_path
from oddrows.sources import logs as src


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, 1.0, 5.0), (2, None, 5.0), (3, float("nan"), 5.0), (4, float("inf"), 5.0), (5, float("-inf"), 5.0), (6, 3.0, 5.0)]
    return spark.createDataFrame(rows, "id long, x double, flat double")


def test_fill(numbers):
    out = {r["id"]: r["x"] for r in ft.impute_median(numbers, ["x"]).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: 2.0, 4: 2.0, 5: 2.0, 6: 3.0}
    row = ft.filled_cells(numbers, ["x", "flat"]).collect()
    assert [(r["feature"], r["median"], r["filled"]) for r in row] == [("x", 2.0, 4)]
    kept = [r["x"] for r in ft.nan_to_zero(ft.inf_to_null(numbers, ["x"]), ["x"]).orderBy("id").collect()]
    assert kept == [1.0, 0.0, 0.0, 0.0, 0.0, 3.0]


def test_constant_column(numbers):
    assert {r["flat"] for r in ft.standardize(numbers, ["flat"]).collect()} == {0.0}
    assert {r["bin"] for r in ft.cut_equal_width(numbers, "flat", 4).collect()} == {1}


def test_describe_ignores_gaps(numbers):
    r = pf.describe_numeric(numbers, ["x"]).first()
    assert (r["count"], r["mean"], r["median"], r["min"], r["max"]) == (2, 2.0, 2.0, 1.0, 3.0)


def test_missing_counts_nan(numbers):
    assert [(r["feature"], r["missing"]) for r in pf.missing_profile(numbers).collect()] == [("x", 2)]


def test_first_edge_is_outside(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (9.0,)], "v double")
    assert [r["bin"] for r in ft.cut_edges(df, "v", [0.0, 1.0, 2.0]).orderBy("v").collect()] == [None, 1, 2, None]


def test_odd_args_keep_their_neighbours(spark):
    text = "[{'name': 'a', 'type': 't', 'value': None}, {'name': 'b', 'type': 'u', 'value': True}, {'name': 'c', 'type': 'v', 'value': 0x1f}, {'name': 'd', 'type': 'w', 'value': [1, 2]}, {'name': 'e', 'type': 'x', 'value': '/a, {b}'}, {'value': 7}]"
    df = ft.flatten_args(ft.parse_args(spark.createDataFrame([(1, text), (2, None), (3, "broken {")], "id long, args string")))
    got = {r["id"]: r for r in df.collect()}
    assert [got[1][f"args_value_{i}"] for i in range(6)] == ["None", "True", "0x1f", "[1,2]", "/a, {b}", "7"]
    assert [got[1][f"args_name_{i}"] for i in range(6)] == ["a", "b", "c", "d", "e", None]
    assert got[2]["parsed"] == got[3]["parsed"] == []


def test_args(spark):
    rows = [
        (1, None),
        (2, "[]"),
        (3, "broken {"),
        (4, "[{'name': 'path', 'type': 'const char*', 'value': '/tmp/a, b'}]"),
        (5, "[" + ", ".join("{'name': 'n%d', 'type': 'int', 'value': %d}" % (i, i) for i in range(7)) + "]"),
    ]
    df = ft.flatten_args(ft.parse_args(spark.createDataFrame(rows, "id long, args string")), 3)
    got = {r["id"]: r for r in ft.flag_pattern(df, ["args_value_0"]).collect()}
    assert [len(got[i]["parsed"]) for i in range(1, 6)] == [0, 0, 0, 1, 7]
    assert got[4]["args_value_0"] == "/tmp/a, b" and got[4]["args_value_0_suspicious"] == 1
    assert got[5]["args_value_2"] == "2" and got[1]["args_value_0_suspicious"] == 0
    nums = {r["id"]: r["args_value_0"] for r in ft.args_to_numeric(df, ["args_value_0"]).collect()}
    assert nums == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_labels_beyond_one_task(spark, small_tasks):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("t"))
    codes = ft.label_codes(df, "t").orderBy("value").collect()
    assert [r["code"] for r in codes] == list(range(2000))


def test_one_hot_unknown_is_zero(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "p string")
    out = ft.one_hot(spark.createDataFrame([("b",), ("z",)], "p string"), ["p"], fit_on=fit).collect()
    assert [r["p_hot"].toArray().tolist() for r in out] == [[0.0, 1.0], [0.0, 0.0]]


def test_read_and_write(spark):
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    src.write_table(spark.createDataFrame([(1.5, "x, 'y' \"z\"")], "timestamp double, args string"), a, "csv")
    src.write_table(spark.createDataFrame([(7, 1)], "evil int, userId long"), b, "csv")
    out = src.read_logs(spark, [a, b, a + "-no"], src.LOG_SCHEMA).collect()
    assert len(out) == 2
    row = next(r for r in out if r["timestamp"] == 1.5)
    assert row["args"] == "x, 'y' \"z\"" and row["evil"] is None
    with pytest.raises(FileNotFoundError):
        src.read_logs(spark, [a + "-no"])


def curve(spark, rows):
    return spark.createDataFrame(rows, "id long, score double, evil int")


def test_one_class_only(spark):
    df = curve(spark, [(1, 0.1, 0), (2, 0.9, 0)])
    assert mt.roc_auc(df, "score", "evil").first()[0] == 0.0
    assert mt.binary_report(mt.apply_threshold(df, "score", 5.0), "evil", "pred").first()["f1"] == 0.0


def test_tied_scores(spark):
    df = curve(spark, [(1, 0.5, 1), (2, 0.5, 0), (3, 0.5, 1), (4, 0.5, 0)])
    assert mt.roc_auc(df, "score", "evil").first()[0] == 0.5
    assert mt.average_precision(df, "score", "evil").first()[0] == 0.5


def test_perfect_ranking(spark):
    df = curve(spark, [(i, float(i), int(i > 6)) for i in range(10)])
    a = mt._areas(df, "score", "evil", []).first()
    assert (a["roc_auc"], a["average_precision"], a["best"]["f1"], a["best"]["score"]) == (1.0, 1.0, 1.0, 7.0)


def test_empty_scores(spark):
    df = curve(spark, [(1, None, 1)])
    assert mt.roc_points(df, "score", "evil").count() == 0


def test_identical_samples_lose_nothing(spark):
    df = spark.range(500).select("id", (F.col("id") % 17).cast("double").alias("a"), F.lit(3.0).alias("flat"))
    for r in il.divergences(df, df, ["a", "flat"]).collect():
        assert abs(r["kl"]) < 1e-12 and abs(r["js"]) < 1e-12


@pytest.mark.parametrize("x", [0.1, 1.0, 4.0, 30.0])
def test_tails(x):
    assert math.isclose(st.gamma_upper(1.0, x / 2), math.exp(-x / 2), rel_tol=1e-10)
    assert math.isclose(st.beta_inc(0.5, 0.5, 1 / (1 + x * x)), 1 - 2 / math.pi * math.atan(x), rel_tol=1e-9)
    assert math.isclose(st.beta_inc(5.0, 1.0, 10 / (10 + 2 * x)), (1 + 2 * x / 10) ** -5, rel_tol=1e-9)


def test_cluster_tests_match_single_tests(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 4).cast("int").alias("cluster"), (F.col("id") % 37).cast("double").alias("num_a"), (F.col("id") % 3).cast("double").alias("cat_b")
    )
    got = {(r["cluster"], r["feature"]): r for r in st.cluster_feature_tests(df, "cluster", ["num_a", "cat_b"], [1, 2]).collect()}
    one = df.withColumn("inside", (F.col("cluster") == 1).cast("int"))
    t = st.welch_t(one, "inside", ["num_a"]).first()
    c = st.chi2_independence(one, "inside", "cat_b").first()
    assert math.isclose(got[1, "num_a"]["p"], t["p"], rel_tol=1e-9) and math.isclose(got[1, "num_a"]["effect_size"], t["effect_size"], rel_tol=1e-9)
    assert math.isclose(got[1, "cat_b"]["p"], c["p"], rel_tol=1e-9) and got[1, "cat_b"]["type"] == "categorical"


def test_short_class_repeats_rows(spark):
    df = spark.range(30).select("id", (F.col("id") < 4).cast("int").alias("y"))
    out = sp.adjust_class_ratio(df, "id", "y", 20, 0.5).collect()
    assert sum(r["y"] for r in out) == 10 and len(out) == 20
    assert len({(r["id"], r["copy"]) for r in out}) == 20


def test_representative_sample(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = rd.kmeans_representative_sample(df, ["a", "b"], "y", "id", 80).cache()
    assert out.count() == 80 and out.select("id").distinct().count() == 80 and out.agg(F.sum("y")).first()[0] == 20


def test_elbow(spark):
    df = spark.createDataFrame([(k, 100.0 / k) for k in range(1, 11)], "k int, cost double")
    row = sd.elbow(df, "k", "cost").first()
    assert row["elbow"] == 3.0 and row["is_knee"] == 1
    line = spark.createDataFrame([(k, 10.0 - k) for k in range(1, 6)], "k int, cost double")
    assert sd.elbow(line, "k", "cost").first()["elbow"] is not None


def test_features_accept_a_stream(spark):
    """Row-wise operators are projections, so they also run on a streaming frame."""
    path = scratch_path(spark, "stream")
    spark.range(20).selectExpr("id", "id AS userId", "id - 10 AS returnValue", "'bash' AS processName").write.parquet(path)
    stream = spark.readStream.schema("id long, userId long, returnValue long, processName string").parquet(path)
    out = ft.flag_interaction(ft.flag_error(ft.sign_bucket(stream, "returnValue", "sign")))
    q = out.writeStream.format("memory").queryName("flags").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(has_error) FROM flags").first()[0] == 10


def test_correlations_of_many_columns_with_holes(spark):
    import numpy as np
    import pandas as pd

    from oddrows.operators.profile import correlation_matrix

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 300)) + rng.normal(size=(60, 1)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 3.0
    names = [f"v.{i}" for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = correlation_matrix(df, names).toPandas()
    table = got.pivot(index="i", columns="j", values="r").to_numpy()
    want = pd.DataFrame(x).corr().to_numpy()
    want[7] = want[:, 7] = np.nan
    assert len(got) == 90_000 and np.allclose(table, want, equal_nan=True, atol=1e-9)
    assert correlation_matrix(df.limit(0), names[:2]).filter("r is not null").count() == 0


def test_leading_is_a_search_without_lambdas(spark):
    """Cells of a sweep are found by a search in generated code; null and ties count as they did in an array."""
    from oddrows.functions.columns import leading

    rows = [(None,), (float("nan"),), *[(v / 4,) for v in range(-4, 30)]]
    df = spark.createDataFrame(rows, "s double")
    for cuts in ([], [1.0], [0.0, 1.0, 1.0, 2.5, 6.0]):
        arr = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
        up = leading([F.lit(c) < F.col("s") for c in cuts])
        down = leading([F.col("s") < F.lit(c) for c in reversed(cuts)])
        got = df.select(up.alias("u"), down.alias("d"), F.size(F.filter(arr, lambda c: c < F.col("s"))).alias("wu"), F.size(F.filter(arr, lambda c: F.col("s") < c)).alias("wd"))
        assert got.filter("u <> wu OR d <> wd").count() == 0
    scored = spark.range(300).select("id", (F.col("id") % 37).cast("double").alias("s"), (F.col("id") % 2).cast("int").alias("evil"))
    for sweep in (mt.quantile_sweep(scored, "s", "evil"), mt.membership_sweep(scored, "s", "evil"), mt.cutoff_sweep(scored, "s", "evil", "id")):
        assert "lambda" not in sweep._jdf.queryExecution().analyzed().toString()
