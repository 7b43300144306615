import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddrows.operators import order as od
from oddrows.operators import sampling as sp
from oddrows.operators import sequences as sq
from oddrows.operators import topk

N = 20_000
PROBS = [0, 0.001, 0.25, 0.5, 0.9, 0.999, 1]


@pytest.fixture(scope="module")
def skewed():
    """More than a third of the rows share one value, and one group holds most rows."""
    rng = np.random.default_rng(1)
    return pd.DataFrame(
        {
            "id": np.arange(N),
            "v": np.where(rng.random(N) < 0.35, 7.0, rng.lognormal(0, 2, N)),
            "g": rng.choice(["a", "b", "c"], N, p=[0.8, 0.15, 0.05]),
            "k": rng.integers(0, 5, N),
        }
    )


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed).repartition(8).cache()


def check_quantiles(frame, skewed):
    q = od.exact_quantiles(frame, ["v", "k"], PROBS).toPandas()
    for c in "vk":
        got = q[q.feature == c].sort_values("prob").value.to_numpy()
        assert np.allclose(got, np.quantile(skewed[c], PROBS), rtol=1e-12)
    q = od.exact_quantiles(frame, ["v"], PROBS, ["g"]).toPandas()
    for g in "abc":
        got = q[q.g == g].sort_values("prob").value.to_numpy()
        assert np.allclose(got, np.quantile(skewed[skewed.g == g].v, PROBS), rtol=1e-12)


def test_quantiles(frame, skewed):
    check_quantiles(frame, skewed)


def test_quantiles_narrowed(frame, skewed, small_tasks):
    check_quantiles(frame, skewed)


def test_many_ranks_narrowed(spark, frame, skewed):
    spark.conf.set("spark.oddrows.taskRows", "6000")
    probs = np.linspace(0, 1, 1001).tolist()
    got = od.exact_quantiles(frame, ["v"], probs).toPandas().sort_values("prob").value.to_numpy()
    assert np.allclose(got, np.quantile(skewed.v, probs), rtol=1e-12)
    spark.conf.unset("spark.oddrows.taskRows")


def test_quantiles_by_column(spark, frame, skewed):
    spark.conf.set("spark.oddrows.taskRows", str(N + 1))  # one column fits a task, two do not
    check_quantiles(frame, skewed)
    spark.conf.unset("spark.oddrows.taskRows")


def test_running_totals(frame):
    counts = frame.groupBy("v").agg(F.count("*").alias("n"))
    out = od.running_totals(counts, "v", ["n"], descending=True).toPandas().sort_values("v", ascending=False)
    assert (out.n.cumsum() == out.cum_n).all()


def test_row_index(frame, skewed):
    out = od.row_index(frame.select("id", "v"), F.desc("v"), "id").toPandas().sort_values("row_index")
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).id.to_numpy()
    assert (out.id.to_numpy() == want).all()
    assert (out.row_index.to_numpy() == np.arange(N)).all()


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.5, 1.0])
def test_top_fraction_with_ties(frame, skewed, frac):
    got = topk.flag_top_fraction(frame, "v", "id", frac).filter("pred = 1").toPandas().id
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).id[: max(1, int(frac * N))]
    assert set(got) == set(want)


def test_samples_do_not_depend_on_the_path(spark, frame, small_tasks):
    y = frame.withColumn("y", (F.col("g") == "a").cast("int"))
    narrow = {r.id for r in sp.stratified_sample(y, "id", "y", 3000).select("id").collect()}
    spark.conf.unset("spark.oddrows.taskRows")
    assert narrow == {r.id for r in sp.stratified_sample(y, "id", "y", 3000).select("id").collect()}
    assert len(narrow) == 3000


def test_sequences_of_a_hot_user(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "u": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)), "t": rng.integers(0, 500, n), "f": rng.integers(0, 2, n)})
    got = sq.consecutive_events(spark.createDataFrame(pdf), "u", "t", "f", "id").toPandas().set_index("u")
    for u, part in pdf.sort_values(["t", "id"]).groupby("u"):
        if len(part) > 1:
            assert got.loc[u, "consecutive"] == ((part.f == 1) & (part.f.shift() == 1)).sum()
            assert got.loc[u, "n"] == len(part)


def test_published_quotas():
    assert sp.balanced_quotas({0: 982_646, 1: 158_432}, 25_000) == {0: 21_529, 1: 3_471}
    assert sp.stratified_quotas({0: 786_116, 1: 126_746}, 20_000) == {0: 17_224, 1: 2_776}


def test_balanced_quotas_floor():
    q = sp.balanced_quotas({0: 10_000, 1: 20}, 100)
    assert q[1] == 10 and sum(q.values()) == 100
