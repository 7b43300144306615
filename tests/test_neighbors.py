import numpy as np
import pandas as pd
import pytest

from oddrows.models.density import components, dbscan, kde_logdensity
from oddrows.operators import neighbors as nb


@pytest.fixture(scope="module")
def planted():
    """Two groups, one small dense group, scattered noise and one point that holds a fifth of the rows."""
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 0.3, (90, 2)), rng.normal(3, 0.3, (90, 2)), rng.uniform(-2, 5, (60, 2)), np.zeros((60, 2))])
    pdf = pd.DataFrame(pts, columns=["a", "b"])
    pdf["id"] = rng.permutation(len(pdf))
    return pdf.sort_values("id").reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark, planted):
    return spark.createDataFrame(planted).cache()


@pytest.fixture(scope="module")
def d2(planted):
    x = planted[["a", "b"]].to_numpy()
    return ((x[:, None] - x[None]) ** 2).sum(-1)


def brute_dbscan(d2, eps, ms):
    near = d2 <= eps * eps
    core = near.sum(1) >= ms
    label = np.full(len(d2), -1)
    c = 0
    for i in range(len(d2)):
        if core[i] and label[i] < 0:
            label[i], todo = c, [i]
            while todo:
                for k in np.nonzero(near[todo.pop()] & core)[0]:
                    if label[k] < 0:
                        label[k] = c
                        todo.append(k)
            c += 1
    for i in np.nonzero(~core)[0]:
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return label


def check_all(frame, planted, d2):
    got = dbscan(frame, ["a", "b"], "id", 0.3, 6).toPandas().sort_values("id").cluster.to_numpy()
    want = brute_dbscan(d2, 0.3, 6)
    assert (got == want).all() and want.max() >= 1 and (want == -1).any()
    k = nb.knn_join(frame, ["a", "b"], "id", 5).toPandas().sort_values(["id", "rank"])
    ids = np.arange(len(d2))
    for i, part in k.groupby("id"):
        assert [j for j in np.lexsort((ids, d2[i])) if j != i][:5] == list(part.neighbor)
    pairs = np.sqrt(d2[np.triu_indices(len(d2), 1)])
    s = nb.pairwise_distance_stats(frame, ["a", "b"], "id").collect()[0]
    assert s["pairs"] == len(pairs)
    assert np.allclose([s["min"], s["max"], s["mean"], s["median"]], [pairs.min(), pairs.max(), pairs.mean(), np.median(pairs)])
    dens = kde_logdensity(frame, ["a", "b"], "id", 0.5).toPandas().sort_values("id").log_density
    want = np.log(np.exp(-d2 / 0.5).sum(1)) - np.log(len(d2)) - 2 * np.log(0.5) - np.log(2 * np.pi)
    assert np.allclose(dens, want)


def test_broadcast_path(frame, planted, d2):
    check_all(frame, planted, d2)


def test_tiled_path(frame, planted, d2, small_tasks):
    check_all(frame, planted, d2)


def test_silhouette_against_brute_force(spark, planted, d2):
    label = brute_dbscan(d2, 0.3, 6)
    df = spark.createDataFrame(planted.assign(cluster=label))
    got = nb.silhouette(df, ["a", "b"], "id", "cluster").first()["silhouette"]
    live = label != -1
    d, lab = np.sqrt(d2[live][:, live]), label[live]
    s = []
    for i in range(len(lab)):
        own = lab == lab[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append(0.0 if own.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    assert np.isclose(got, np.mean(s))


def test_silhouette_of_one_cluster(frame):
    from pyspark.sql import functions as F

    assert nb.silhouette(frame.withColumn("c", F.lit(1)), ["a", "b"], "id", "c").first()["silhouette"] == -1.0


def test_all_noise(frame):
    out = dbscan(frame, ["a", "b"], "id", 1e-6, 1000).select("cluster").distinct().collect()
    assert [r["cluster"] for r in out] == [-1]


@pytest.mark.parametrize("limit", ["50000", "3"])
def test_components(spark, limit):
    spark.conf.set("spark.oddrows.broadcastRows", limit)
    chain = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (200, 201)]
    got = {r["pid"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    spark.conf.unset("spark.oddrows.broadcastRows")
    assert got == {**{i: 0 for i in range(21)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}


def test_nearest_assign_ties_and_nulls(spark):
    ref = spark.createDataFrame([(1, 0.0, "x"), (2, 2.0, "y")], "id long, a double, c string")
    q = spark.createDataFrame([(10, 1.0), (11, 1.9), (12, None)], "id long, a double")
    got = {r["id"]: (r["c"], r["distance"]) for r in nb.nearest_neighbor_assign(q, ref, ["a"], "id", "c").collect()}
    assert got[10] == ("x", 1.0) and got[11][0] == "y" and got[12] == (None, None)


def test_centers_listed_or_tiled(spark, monkeypatch):
    from oddrows.operators import joins as jn

    x = np.random.default_rng(8).normal(size=(30, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(c=np.arange(30)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for listed in (2000, 5):
        monkeypatch.setattr(jn, "MAX_LISTED", listed)
        got = jn.center_distances(df, "c", ["a", "b"]).toPandas()
        assert len(got) == 900 and np.allclose(got.distance, d[got.a, got.b])
        far = d + np.diag(np.full(30, np.inf))
        assert np.isclose(jn.min_center_separation(df, "c", ["a", "b"]).first()[0], far.min(1).mean())


def test_two_rounds_visit_less(spark, monkeypatch):
    """Same neighbours as a plain search, from fewer pairs than whole cells by their farthest rows would take."""
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (2000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("ab")).assign(id=np.arange(len(x))))
    points = nb.distinct_points(df, list("ab"), "id")
    query = points.select(points.pid.alias("qid"), "x")
    monkeypatch.setattr(nb, "NEAR_ROWS", 100)
    k = 6

    def fn(q, r, d2):
        at = np.argsort(d2, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(d2)), at.shape[1])
        return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "pid": r["pid"].to_numpy()[at.ravel()], "d2": d2[row, at.ravel()]})

    parts, visits = nb.two_rounds(query, points, k, fn, "qid long, pid long, d2 double", "d2")
    found = parts.toPandas().sort_values(["qid", "d2", "pid"]).groupby("qid").head(k)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    for q, part in found.groupby("qid"):
        assert np.allclose(np.sort(d2[q])[:k], part.d2)
    cells = nb.cells_of(points, 100)
    whole = nb.routed(query, cells, nb.pruned(cells, k, False))
    sizes = dict(zip(cells.ids.tolist(), cells.sizes.tolist()))
    pairs = [sum(sizes[r["_cell"]] * r["count"] for r in v.groupBy("_cell").count().collect()) for v in (visits, whole)]
    assert pairs[0] < 0.6 * pairs[1] and pairs[0] < 0.2 * len(x) ** 2


def test_distances_from_products_keep_near_pairs_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(5, 1, (700, 32))
    x[1], x[2] = x[0], x[0] + 1e-9
    got = np.zeros((700, 700))
    for i, j, d2, _ in nb.distance_chunks(x, x):
        got[i : i + d2.shape[0], j : j + d2.shape[1]] = d2
    want = nb.sq_distances(x, x)
    assert (got[:3, :3] == want[:3, :3]).all() and np.abs(np.sqrt(got) - np.sqrt(want)).max() < 1e-9


@pytest.fixture(scope="module")
def wide(spark):
    """Wide points, where no cell can be ruled out; some rows are equal, some equidistant."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (500, 20)), np.eye(20), -np.eye(20)])
    x = np.vstack([x, x[:30]])
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(20)]).assign(id=rng.permutation(len(x)), c=rng.integers(0, 3, len(x)))
    return spark.createDataFrame(pdf).cache(), pdf.sort_values("id")


def test_wide_points_meet_in_blocks(wide, small_tasks, monkeypatch):
    df, pdf = wide
    xs = [f"x{i}" for i in range(20)]
    monkeypatch.setattr(nb, "MEDIAN_VALUES", 50)
    points = nb.distinct_points(df, xs, "id")
    query = points.select(points.pid.alias("qid"), "x")
    seen = []
    keep = nb.all_pairs
    monkeypatch.setattr(nb, "all_pairs", lambda *a, **k: seen.append(1) or keep(*a, **k))
    nb._nearest_points(query, points, 3)
    assert seen  # the second round would send every row with its coordinates to every cell
    x = pdf[xs].to_numpy()
    d2 = nb.sq_distances(x, x)
    k = nb.knn_join(df, xs, "id", 5).toPandas().sort_values(["id", "rank"])
    ids = pdf["id"].to_numpy()
    for i, part in k.groupby("id"):
        at = list(ids).index(i)
        assert [ids[j] for j in np.lexsort((ids, d2[at])) if j != at][:5] == list(part.neighbor)
    stats = {r["scope"]: r for r in nb.pairwise_distance_stats(df, xs, "id", "c").collect()}
    pairs = np.sqrt(d2[np.triu_indices(len(x), 1)])
    s = stats["all"]
    assert s["pairs"] == len(pairs) and np.allclose([s["min"], s["max"], s["mean"], s["median"]], [pairs.min(), pairs.max(), pairs.mean(), np.median(pairs)])
    for v in range(3):
        own = pdf["c"].to_numpy() == v
        part = np.sqrt(d2[own][:, own][np.triu_indices(own.sum(), 1)])
        assert stats[str(v)]["pairs"] == len(part) and np.allclose([stats[str(v)]["min"], stats[str(v)]["max"], stats[str(v)]["mean"]], [part.min(), part.max(), part.mean()])
    d, lab = np.sqrt(d2), pdf["c"].to_numpy()
    a = np.array([d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1) for i in range(len(d))])
    b = np.array([min(d[i, lab == c].mean() for c in set(lab) - {lab[i]}) for i in range(len(d))])
    assert np.isclose(nb.silhouette(df, xs, "id", "c").first()["silhouette"], ((b - a) / np.maximum(a, b)).mean())


def test_routing_hands_on_bounded_pieces(wide, monkeypatch):
    df, _ = wide
    monkeypatch.setattr(nb, "ROUTED_ROWS", 50, raising=False)
    sizes = []

    class Query:
        sparkSession, schema = df.sparkSession, nb.distinct_points(df, [f"x{i}" for i in range(20)], "id").schema

        def mapInPandas(self, fn, schema):
            rows = nb.distinct_points(df, [f"x{i}" for i in range(20)], "id").toPandas()
            sizes.extend(len(p) for p in fn([rows]))

    cells = nb.Cells(None, np.arange(4), np.zeros((4, 20)), np.ones(4), np.ones(4), np.ones(4), np.ones(4))
    monkeypatch.setattr(nb, "cut_lineage", lambda d: d)
    nb.routed(Query(), cells, lambda b, d: np.ones_like(d, dtype=bool))
    assert sum(sizes) == 4 * 540 and max(sizes) <= 50
