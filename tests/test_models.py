import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddrows.models import clustering as cl
from oddrows.models import isolation, linear, nets, svm
from oddrows.models import trees as tr
from oddrows.models.common import load_model, save_model
from oddrows.operators import metrics as mt
from oddrows.session import scratch_path

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def bulk():
    """Correlated bulk plus one percent far rows."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=(990, 2))
    x = np.column_stack([z[:, 0], z[:, 0] * 0.8 + 0.2 * z[:, 1], z[:, 1]])
    far = rng.uniform(6, 8, (10, 3)) * rng.choice([-1, 1], (10, 3))
    pdf = pd.DataFrame(np.vstack([x, far]), columns=XS)
    return pdf.assign(id=np.arange(1000), evil=(np.arange(1000) >= 990).astype(int))


@pytest.fixture(scope="module")
def frame(spark, bulk):
    return spark.createDataFrame(bulk).repartition(4).cache()


def area(df):
    return mt.roc_auc(df, "score", "evil").first()[0]


def test_pca(spark, frame, bulk):
    m = linear.pca_fit(frame, XS, 3)
    assert np.allclose(m.axes @ m.axes.T, np.eye(3))
    values = np.sort(np.linalg.eigvalsh(np.cov(bulk[XS].T)))[::-1]
    assert np.allclose(m.ratio, values / values.sum())
    assert linear.pca_score(frame, m).agg(F.max("reconstruction_error")).first()[0] < 1e-20
    back = linear.pca_inverse(linear.pca_transform(frame.select("id", *XS), m), m).toPandas().sort_values("id")
    assert np.allclose(back[XS], bulk[XS])
    top = linear.pca_importance(spark, m).first()
    assert math.isclose(top["importance"], np.abs(m.axes).sum(axis=0).max())


def test_mca_inertia_and_distances(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(200), "p": rng.choice(list("xyz"), 200), "q": rng.choice(list("uv"), 200)})
    df = spark.createDataFrame(pdf)
    m = linear.mca_fit(df, ["p", "q"], 3)
    z = pd.get_dummies(pdf[["p", "q"]]).to_numpy(dtype=float)
    prob = z / z.sum()
    r, c = prob.sum(1), prob.sum(0)
    s = (prob - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    values = np.linalg.svd(s, compute_uv=False)[:3] ** 2
    assert np.allclose(m.inertia, values)
    out = linear.category_coordinates(df, m, "m_").toPandas().sort_values("id")
    coords = out[["m_0", "m_1", "m_2"]].to_numpy()
    profile = (z / z.sum(1, keepdims=True)) / np.sqrt(c)
    d = lambda x: ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(d(coords), d(profile))


def test_onehot_svd(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "uvw"[i % 3]) for i in range(30)], "id long, p string, q string")
    m = linear.onehot_svd_fit(df, ["p", "q"], 5)
    z = pd.get_dummies(df.toPandas()[["p", "q"]]).to_numpy(dtype=float)
    assert np.allclose(np.sqrt(np.maximum(m.inertia, 0)), np.linalg.svd(z, compute_uv=False), atol=1e-6)


def test_category_axes_by_iteration(spark):
    rng = np.random.default_rng(12)
    group = rng.integers(0, 4, 600)
    letter = lambda n, noise: [f"{g}{k}" if u > noise else f"x{k}" for g, k, u in zip(group, rng.integers(0, n, 600), rng.random(600))]
    pdf = pd.DataFrame({"id": np.arange(600), "p": letter(6, 0.1), "q": letter(4, 0.2), "r": letter(2, 0.4)})
    pdf.loc[::50, "q"] = None
    df = spark.createDataFrame(pdf)
    for fit in (linear.mca_fit, linear.onehot_svd_fit):
        a, b = (fit(df, ["p", "q", "r"], 3, dense=n) for n in (1000, 0))
        assert np.allclose(a.inertia, b.inertia, rtol=1e-6)
        x, y = (linear.category_coordinates(df, m, "m_").toPandas().sort_values("id")[["m_0", "m_1", "m_2"]].to_numpy() for m in (a, b))
        assert np.allclose(x, y, atol=2e-3 * np.abs(x).max())


def test_a_hundred_thousand_categories(spark):
    wide = spark.range(50_000).selectExpr("id", "concat(id % 5, '-', id) AS p", "concat(id % 5, '/', (id * 7) % 50000) AS q", "id % 5 AS g")
    m = linear.mca_fit(wide.union(wide.selectExpr("id", "concat('g', g)", "concat('g', g)", "g")), ["p", "q"], 2)
    assert m.table.count() == 100_010 and len(m.inertia) == 2 and (m.inertia <= 1 + 1e-9).all() and m.inertia[0] >= m.inertia[1] > 0


def test_kmeans(frame, bulk):
    costs = [cl.kmeans_fit(frame, XS, 5, "id", max_iter=i).cost for i in (1, 20)]
    assert costs[1] <= costs[0]
    rows, model = cl.kmeans(frame, XS, 5, "id")
    got = rows.toPandas()
    d = ((got[XS].to_numpy()[:, None] - model.centers[None]) ** 2).sum(-1)
    assert (got.cluster == d.argmin(1)).all() and np.allclose(got.distance, np.sqrt(d.min(1)))
    assert np.isclose(d.min(1).sum(), model.cost)


def test_kmeans_is_the_best_of_its_starts(spark, frame):
    points = cl.training_points(frame, XS, "id")
    several = cl.kmeans_models(points, XS, [2, 5, 9])
    single = [cl.kmeans_models(points, XS, [5], seed=s, starts=1)[5].cost for s in range(42, 52)]
    assert several[5].cost <= min(single) * 1.02 and several[2].cost > several[5].cost > several[9].cost
    assert np.isclose(several[5].cost, cl.kmeans_models(points, XS, [5])[5].cost)
    x = frame.toPandas()[XS].to_numpy()
    for k, model in several.items():
        label = ((x[:, None] - model.centers[None]) ** 2).sum(-1).argmin(1)
        means = np.array([x[label == c].mean(0) for c in range(k)])
        assert np.abs(means - model.centers).max() < 0.05  # a fixed point, up to the tolerance
    few = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.0)], "id long, a double, b double")
    assert len(cl.kmeans_fit(few, ["a", "b"], 5, "id").centers) == 2
    assert len(cl.kmeans_fit(few.limit(0), ["a", "b"], 5, "id").centers) == 0


def test_center_index():
    rng = np.random.default_rng(3)
    centers = np.vstack([rng.normal(c, 0.3, (300, 3)) for c in rng.uniform(-9, 9, (8, 3))])
    x = np.vstack([rng.normal(size=(500, 3)) * 5, centers[::7]])
    index = cl.CenterIndex(centers)
    label, d2 = index.nearest(x)
    full = ((x[:, None] - centers[None]) ** 2).sum(-1)
    assert (label == full.argmin(1)).all() and np.allclose(d2, full.min(1))
    assert index.compared < 0.3 * full.size


def test_representatives_fill_the_quota(frame):
    from oddrows.operators.sampling import stratified_quotas
    from oddrows.plans import reduction

    rows = reduction.kmeans_representative_sample(frame, XS, "evil", "id", 300).toPandas()
    quotas = stratified_quotas({0: 990, 1: 10}, 300)
    assert rows.groupby("evil").size().to_dict() == quotas and rows.id.is_unique


def test_many_centers_use_arrow(frame):
    centers = np.random.default_rng(0).normal(size=(400, 3))
    a = cl.nearest_center(frame, XS, centers).toPandas()
    d = ((a[XS].to_numpy()[:, None] - centers[None]) ** 2).sum(-1)
    assert (a.cluster == d.argmin(1)).all()


def test_gmm(frame):
    model = cl.gmm_fit(frame, XS, 2, "id")
    out = cl.gmm_score(frame, model).toPandas()
    x = out[XS].to_numpy()
    dens = 0
    for w, mean, cov in zip(model.weights, model.means, model.covs):
        cov = cov + np.eye(3) * 1e-6
        e = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        dens = dens + w * np.exp(-0.5 * e) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov))
    assert np.allclose(out.log_likelihood, np.log(dens))


def test_fuzzy(frame):
    rows, model = cl.fuzzy_cmeans(frame, XS, 3, "id")
    out = rows.toPandas()
    u = np.stack(out.u)
    assert np.allclose(u.sum(1), 1) and np.allclose(u.max(1), out.max_membership)
    x = out[XS].to_numpy()
    fixed = (u**2).T @ x / (u**2).sum(0)[:, None]
    assert np.abs(fixed - model.centers).max() < 0.01


def test_ward_is_exact_on_few_points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(40)))
    rows, _ = cl.hierarchical(df, ["a", "b"], 4, "id")
    got = rows.toPandas().sort_values("id").cluster.to_numpy()
    groups = [[i] for i in range(40)]
    cost = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    while len(groups) > 4:
        best = min(((cost(a + b) - cost(a) - cost(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    assert sorted(map(sorted, groups)) == sorted(sorted(np.nonzero(got == c)[0].tolist()) for c in set(got))


def merged_one_by_one(x, w, ks):
    """Ward labels for each k by merging the cheapest pair of all, again and again."""
    c, w, owner, out = x.astype(float).copy(), w.astype(float).copy(), np.arange(len(x)), {}
    live = np.ones(len(x), bool)
    d = ((c[:, None] - c[None]) ** 2).sum(-1) * (w[:, None] * w / (w[:, None] + w))
    np.fill_diagonal(d, np.inf)
    for left in range(len(x), 0, -1):
        if left in ks:
            out[left] = owner.copy()
        i, j = sorted(divmod(int(d.argmin()), len(c)))
        c[i] = (c[i] * w[i] + c[j] * w[j]) / (w[i] + w[j])
        w[i] += w[j]
        owner[owner == j] = i
        live[j] = False
        row = np.where(live, ((c - c[i]) ** 2).sum(1) * (w * w[i] / (w + w[i])), np.inf)
        row[i] = np.inf
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
    return out


def test_ward_on_many_points(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 2)) * rng.choice([0.2, 1.0, 5.0], (2000, 1)) + rng.choice([0.0, 9.0], (2000, 1))
    copies = rng.integers(1, 4, 2000)
    at = np.repeat(np.arange(2000), copies)
    df = spark.createDataFrame(pd.DataFrame(x[at], columns=["a", "b"]).assign(id=np.arange(len(at))))
    first = np.searchsorted(at, np.arange(2000))
    ks = (1, 3, 40, 400)
    want = merged_one_by_one(x, copies, ks)
    spark.conf.set("spark.oddrows.broadcastRows", "900")  # the first rounds search by cells
    try:
        trees = [cl.ward_tree(cl.training_points(df, ["a", "b"], "id"), finish) for finish in (2000, 500)]
    finally:
        spark.conf.unset("spark.oddrows.broadcastRows")
    assert len(trees[0].rounds) == 0 and len(trees[1].rounds) > 2 and len(trees[1].last) < 500
    for tree in trees:
        several = tree.labels(ks).toPandas().sort_values("pid")
        for k in ks:
            roots = several[f"root_{k}"].to_numpy()
            assert len(set(zip(roots, want[k]))) == k == len(set(roots))
    rows, model = cl.hierarchical(df, ["a", "b"], 40, "id", tree=trees[1])
    got = rows.toPandas().sort_values("id").cluster.to_numpy()[first]
    assert len(set(zip(got, want[40]))) == 40
    for c in (0, 39):
        assert np.allclose(model.centers[c], np.average(x[got == c], axis=0, weights=copies[got == c]))


def test_ward_of_ties_chains_and_few_points(spark):
    grid = pd.DataFrame([(float(i), float(j)) for i in range(6) for j in range(6)], columns=["a", "b"])
    chain = pd.DataFrame({"a": 1.5 ** np.arange(24), "b": 0.0})
    for points in (grid, chain):
        df = spark.createDataFrame(points.assign(id=np.arange(len(points))))
        assert cl.hierarchical(df, ["a", "b"], 7, "id", finish=20)[0].select("cluster").distinct().count() == 7
    few = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0), (4, 2.0, 2.0)], "id long, a double, b double")
    rows = {r["id"]: r["cluster"] for r in cl.hierarchical(few, ["a", "b"], 5, "id")[0].collect()}
    assert rows == {1: 0, 2: 0, 3: None, 4: 1}


def test_isolation_forest(frame):
    out = isolation.isolation_forest(frame, XS, "id", trees=50, sub=128).cache()
    lo, hi = out.agg(F.min("score"), F.max("score")).first()
    assert 0 < lo < hi < 1 and area(out) > 0.97


def test_one_class_svm(frame):
    out = svm.one_class_svm(frame, XS, "id", fit_on=frame.filter("evil = 0"), nu=0.05).cache()
    assert area(out) > 0.95
    outside = out.filter("evil = 0 AND score > 0").count()
    assert outside <= 0.05 * 990


def test_one_class_svm_ranks_like_the_exact_problem(spark, frame, bulk):
    x, n = bulk[XS].to_numpy(), 1000
    for nu in (0.05, 0.2):
        spark.sparkContext.setJobGroup(f"svm{nu}", "")
        model = svm.svm_fit(frame, XS, "id", nu=nu)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"svm{nu}")
        spark.sparkContext.setJobGroup("", "")
        assert model.error <= 1e-3
        kernel = np.exp(-model.gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        lifted = svm._lift(x, model.landmarks, svm._map_of(model.landmarks, model.gamma), model.gamma)
        assert np.isclose(model.error, (1 - (lifted**2).sum(1)).mean(), atol=1e-9) and np.abs(kernel - lifted @ lifted.T).max() < 0.05
        # the dual by accelerated projected gradients
        most = 1 / (nu * n)

        def onto(v, most=most):
            low, high = v.min() - most - 1, v.max() + 1
            for _ in range(45):
                middle = (low + high) / 2
                low, high = (middle, high) if np.clip(v - middle, 0, most).sum() > 1 else (low, middle)
            return np.clip(v - high, 0, most)

        a = y = onto(np.full(n, 1 / n))
        t, slope = 1.0, np.linalg.norm(kernel, 2)
        for _ in range(1500):
            b = onto(y - kernel @ y / slope)
            t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            y, a = b + (old - 1) / t * (b - a), b
        ranks = [pd.Series(v).rank() for v in (model.project(x), kernel @ a)]
        assert ranks[0].corr(ranks[1]) > 0.99
        assert len(jobs) < 40, (len(jobs), model.passes)


def test_autoencoder(spark, frame):
    net = nets.autoencoder_fit(frame.filter("evil = 0"), XS, "id", latent=2, hidden=(8,), rounds=10)
    out = nets.autoencoder_score(frame, net).withColumnRenamed("reconstruction_error", "score").cache()
    assert net.history[-1] < net.history[0] and area(out) > 0.9
    path = save_model(spark, nets.net_params(net), scratch_path(spark, "net"))
    again = nets.net_from_params(XS, load_model(spark, path))
    assert np.array_equal(again.theta, net.theta)


def test_autoencoder_gradients():
    rng = np.random.default_rng(0)
    for kl in (None, 0.1):
        enc, dec = nets._shapes([3, 5, 2 if kl is None else 4]), nets._shapes([2, 5, 3])
        net = nets.Net(XS, enc, dec, nets._init([*enc, *dec], rng), 2, kl)
        x, w, e = rng.normal(size=(7, 3)), rng.uniform(1, 3, 7), rng.normal(size=(7, 2))
        _, g = nets._loss(net, net.theta, x, w, e)
        for i in range(0, len(net.theta), 5):
            step = np.zeros_like(net.theta)
            step[i] = 1e-6
            num = (nets._loss(net, net.theta + step, x, w, e)[0] - nets._loss(net, net.theta - step, x, w, e)[0]) / 2e-6
            assert abs(num - g[i]) < 1e-4 * max(1, abs(num))


def test_vae(spark, frame):
    net = nets.vae_fit(frame.filter("evil = 0"), XS, "id", latent=2, hidden=(8,), rounds=10)
    out = nets.vae_score(frame, net).toPandas()
    assert (out.kl_divergence >= 0).all()
    assert np.allclose(out.total_loss, out.reconstruction_error + net.kl_weight * out.kl_divergence)
    assert nets.generate(spark, net, 25).count() == 25


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=list("pqrs")).assign(id=np.arange(600), evil=y)).repartition(3).cache()


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_shapley_sums_to_prediction(labelled, kind):
    cols = list("pqrs")
    t = tr.tree_model(labelled, cols, "evil", kind, depth=4, trees=5)
    pred = {r["id"]: r["score"] for r in tr.predict(labelled, t).collect()}
    point = {tuple(r["x"]): r for r in tr.shap_values(labelled, t).collect()}
    for r in labelled.collect():
        s = point[tuple(r[c] for c in cols)]
        assert math.isclose(s["base"] + sum(s["phi"]), pred[r["id"]], abs_tol=1e-9)


def test_shapley_of_two_features_by_hand(labelled):
    """Against the definition: average over orders of the conditional expectation."""
    from itertools import permutations

    cols = list("pqrs")
    t = tr.tree_model(labelled, cols, "evil", "tree", depth=3)
    games, base = tr._leaf_games(labelled.sparkSession, t)
    x = np.array([[0.5, 0.1, -0.3, 0.2]])

    def known(subset):
        return sum(v * math.prod(float(lo < x[0, i] <= hi) if i in subset else cov for i, lo, hi, cov in path) for v, path in games)

    want = np.zeros(4)
    for order in permutations(range(4)):
        seen = set()
        for i in order:
            want[i] += known(seen | {i}) - known(seen)
            seen.add(i)
    assert np.allclose(tr._shapley(x, games)[0], want / 24)
    assert math.isclose(known(set()), base)


def test_nearest_of_wide_centers(monkeypatch):
    """Products find the centres and distances of the differences to the last bit, ties and far offsets included, and form few differences."""
    rng = np.random.default_rng(6)
    x, centers = rng.normal(size=(400, 32)), rng.normal(size=(10, 32))
    centers[7] = centers[2]
    x[:10], x[10:20] = centers, (centers[3] + centers[4]) / 2
    formed = []
    plain = cl.sq_distances
    monkeypatch.setattr(cl, "sq_distances", lambda q, r: formed.append(len(q)) or plain(q, r))
    for shift in (0.0, 1e6):
        formed.clear()
        label, d2 = cl.CenterIndex(centers + shift).nearest(x + shift)
        want = plain(x + shift, centers + shift)
        assert (label == want.argmin(axis=1)).all() and (d2 == want.min(axis=1)).all()
        assert shift or sum(formed) < 200
    assert len(cl.CenterIndex(centers).nearest(x[:0])[0]) == 0


def test_few_points_are_scored_once(spark):
    """Equal rows share one score; many different points are scored row by row. Null, NaN and -0.0 are points as well."""
    seen = spark.sparkContext.accumulator(0)

    class Line:
        cols, rho = ["p"], 1.0

        def project(self, x):
            seen.add(len(x))
            return np.array([-1.0 if v is None or v != v else v for v in x[:, 0]])

    p = F.when(F.col("id") % 7 == 5, F.lit(math.nan)).when(F.col("id") % 14 == 0, F.lit(-0.0)).otherwise((F.col("id") % 7).cast("double"))
    df = spark.range(1000).select("id", p.alias("p"))
    few = {r["id"]: r["score"] for r in svm.svm_score(df, Line()).collect()}
    assert seen.value == 7 and len(few) == 1000
    assert all(v == (2.0 if i % 7 == 5 else 1.0 - i % 7) for i, v in few.items())
    spark.conf.set("spark.oddrows.broadcastRows", "3")
    try:
        assert {r["id"]: r["score"] for r in svm.svm_score(df, Line()).collect()} == few
    finally:
        spark.conf.unset("spark.oddrows.broadcastRows")
    assert seen.value == 1007


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_tree_rows_are_read_once_by_many_tasks(spark, kind, monkeypatch):
    """A fit makes its rows once, whatever its passes, and a table in one piece is dealt over the cores."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x

    fitted = []
    for cls in (tr.DecisionTreeClassifier, tr.RandomForestClassifier):
        fit = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, rows, fit=fit: fitted.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    df = spark.range(0, 50_000, 1, 1).select(counted(F.rand(3)).alias("p"), F.rand(4).alias("q"))
    tr.tree_model(df.withColumn("evil", (F.col("q") > 0.5).cast("int")), ["p", "q"], "evil", kind, depth=3, trees=2)
    assert seen.value == 50_000 and fitted == [3]


def test_shapley_tables(monkeypatch):
    """Leaves looked up in tables give what the sums over the rows give, also in pieces."""
    rng = np.random.default_rng(4)
    games = []
    for m in (1, 2, 3, 4, 4, 4):
        path = sorted((int(i), float(lo), float(lo + 1.0), float(rng.random())) for i, lo in zip(rng.permutation(4)[:m], rng.normal(size=m)))
        games.append((float(rng.random()), path))
    x = np.vstack([rng.normal(size=(50, 4)), np.full((1, 4), np.nan)])
    want = np.zeros(x.shape)
    for value, path in games:
        for i, v in tr._leaf_phi(x, value, path).items():
            want[:, i] += v
    assert np.allclose(tr._shapley(x, games), want)
    monkeypatch.setattr(tr, "TABLE_CELLS", 100)
    assert np.allclose(tr._shapley(x, games), want)
    monkeypatch.setattr(tr, "TABLE_FEATURES", 2)
    assert np.allclose(tr._shapley(x, games), want)


def test_shap_importance_meets_cells(spark, labelled):
    """Rows between the same thresholds are one point; the importance is that of all rows."""
    cols = list("pqrs")
    t = tr.tree_model(labelled, cols, "evil", "forest", depth=2, trees=2)
    games, _ = tr._leaf_games(spark, t)
    cells = tr.threshold_cells(labelled, cols, games).toPandas()
    assert cells.w.sum() == 600 and len(cells) < 300
    every = tr.shap_values(labelled, t).toPandas()
    want = np.average(np.abs(np.stack(every.phi)), axis=0, weights=every.w)
    got = {r["feature"]: r["importance"] for r in tr.shap_importance(labelled, t).collect()}
    assert np.allclose([got[c] for c in cols], want)


def test_tree_reports(spark, labelled):
    cols = list("pqrs")
    t = tr.tree_model(labelled, cols, "evil", "tree", depth=3)
    rules = tr.tree_rules(labelled, t).collect()
    assert sum(r["n"] for r in rules) == 600
    for r in rules:
        found = labelled.filter(r["rule"]).agg(F.count("*"), F.sum("evil")).first()
        assert abs(found[0] - r["n"]) <= 1  # thresholds are printed with six digits
    for r in tr.tree_thresholds(labelled, t).collect():
        left = labelled.filter(F.col(r["feature"]) <= r["threshold"])
        assert left.count() == r["n_left"] and r["n_left"] + r["n_right"] == 600
    f = tr.tree_model(labelled, cols, "evil", "forest", depth=3, trees=6)
    use = tr.forest_usage(spark, f).collect()
    assert {r["kind"] for r in use} == {"depth", "features per tree", "splits", "together"}
    leaves = tr.leaf_rows(labelled, f).groupBy("tree").agg(F.sum("n").alias("n")).collect()
    assert [r["n"] for r in leaves] == [600] * 6


def test_permutation_importance(labelled):
    t = tr.tree_model(labelled, list("pqrs"), "evil", "tree", depth=3)
    got = {r["feature"]: r["importance"] for r in tr.permutation_importance(labelled, t, "id", repeats=3).collect()}
    assert got["p"] > 0.1 and got["q"] > 0.1 and abs(got["r"]) < 0.05


def test_balanced_weights(spark):
    even = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, y int")
    assert {r["weight"] for r in tr.balanced_weights(even, "y").collect()} == {1.0}
    odd = spark.createDataFrame([(i, int(i == 0)) for i in range(24)], "id int, y int")
    got = {r["y"]: r["weight"] for r in tr.balanced_weights(odd, "y").collect()}
    assert got == {1: 12.0, 0: 24 / 46}


def test_nets_do_not_hang_on_partitions(spark, frame):
    points = nets.training_points(frame.filter("evil = 0"), XS, "id")
    for kl in (None, 0.05):
        found = [nets._fit(None, XS, "id", 2, (6,), 4, 0.01, 42, 1e-4, 1e-4, kl, points=points.repartition(n)) for n in (1, 4, 16)]
        assert all(np.allclose(found[0].theta, f.theta, atol=1e-7) for f in found[1:])
        assert found[0].history[-1] < found[0].history[0]
    heavy = nets._fit(None, XS, "id", 2, (6,), 4, 0.01, 42, 1e-4, 2000.0, None, points=points)
    on = nets._weights_only(heavy) > 0
    assert np.abs(heavy.theta[on]).sum() < 0.8 * np.abs(nets._fit(None, XS, "id", 2, (6,), 4, 0.01, 42, 1e-4, 0.0, None, points=points).theta[on]).sum()


# --- grids ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.5, (60, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 0))]).round(1)
    pdf = pd.DataFrame(x, columns=XS).assign(id=range(180), evil=[int(i >= 120 or i % 17 == 0) for i in range(180)])
    return spark.createDataFrame(pdf).cache()


def test_quality_from_moments(blobs):
    from oddrows.models.density import dbscan
    from oddrows.operators import neighbors as nb
    from oddrows.operators.joins import broadcast_verdict
    from oddrows.plans import studies as sd

    rows = dbscan(blobs, XS, "id", 0.6, 5)
    q = sd.cluster_quality(rows, XS, "id", "evil")
    assert math.isclose(q["silhouette"], nb.silhouette(rows, XS, "id", "cluster", exact=False).first()["silhouette"])
    assert math.isclose(q["mi"], mt.mutual_information(rows, "cluster", "evil").first()["mi"])
    verdicts = sd.label_clusters(rows.filter("cluster <> -1"))
    plain = mt.posneg_metrics(broadcast_verdict(rows, verdicts, verdict="pred"), "evil", "pred").first()
    assert (q["precision"], q["recall"], q["f1"]) == (plain["precision_pos"], plain["recall_pos"], plain["f1_pos"])
    assert q["n"] == 180 and q["noise"] == rows.filter("cluster = -1").count() and q["n_clusters_found"] == 3
    exact = nb.silhouette(rows, XS, "id", "cluster").first()["silhouette"]
    assert math.isclose(sd.cluster_quality(rows, XS, "id", "evil", exact=True)["silhouette"], exact)


def test_internal_grid(blobs):
    from oddrows.plans import studies as sd

    grid = sd.internal_grid(blobs, XS, "id", "evil", [2, 3], [2, 3, 500], ["kmeans", "hierarchical", "dbscan", "gmm", "fcm"]).toPandas()
    assert len(grid) == 30 and grid.n.isin([0, 180]).all()
    three = grid[grid.n_clusters == 3]
    assert (three[three.algorithm != "dbscan"].silhouette > 0.9).all() and (three[three.algorithm != "dbscan"].f1 > 0.9).all()
    none = grid[(grid.n_clusters == 500) & grid.algorithm.isin(["hierarchical", "gmm", "fcm"])]
    assert (none.silhouette == -1).all() and (none.n_clusters_found == 0).all()
    assert (grid[grid.algorithm == "kmeans"].inertia.notna()).all()


def test_dbscan_grid(blobs):
    from oddrows.models.density import dbscan
    from oddrows.models.linear import pca_fit, pca_transform
    from oddrows.plans import studies as sd

    grid = sd.dbscan_grid(blobs, XS, "id", "evil", [2, 3], [0.3, 0.6], [5, 10]).toPandas()
    assert len(grid) == 8
    projected = pca_transform(blobs, pca_fit(blobs, XS, 2))
    want = sd.cluster_quality(dbscan(projected, ["pc_0", "pc_1"], "id", 0.3, 5), ["pc_0", "pc_1"], "id", "evil")
    from oddrows.models import density
    from oddrows.operators.neighbors import distinct_points

    points = distinct_points(blobs, XS, "id")
    local, limit = density.dbscan_settings(points, [(0.3, 5), (0.6, 8)]).toPandas().sort_values("pid"), density.LOCAL_POINTS
    try:
        density.LOCAL_POINTS = 1
        spread = density.dbscan_settings(points, [(0.3, 5), (0.6, 8)]).toPandas().sort_values("pid")
    finally:
        density.LOCAL_POINTS = limit
    assert (local[["pid", "c0", "c1"]].to_numpy() == spread[["pid", "c0", "c1"]].to_numpy()).all() and local.c1.max() > 0
    got = grid[(grid.pca_dim == 2) & (grid.eps == 0.3) & (grid.min_samples == 5)].iloc[0]
    assert all(math.isclose(got[m], want[m]) for m in sd.QUALITY)


def test_external_eval_of_ward_and_others(blobs):
    from oddrows.plans import studies as sd

    for method in ("hierarchical", "kmeans", "dbscan"):
        out = sd.external_eval(blobs, XS, "id", "evil", method, 3, 2, fracs=(0.2, 0.5)).toPandas()
        assert len(out) == 2 and out.f1_pos_mean.between(0, 1).all()


def test_permutation_importance_broadcasts_no_rows(spark):
    """Few distinct values make small files; the rows joined to rows are as many as ever."""
    df = spark.range(3000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(id % 7 > 3 AS INT) AS y")
    model = tr.tree_model(df, ["a", "b"], "y", "tree")
    out = tr.permutation_importance(df, model, "id", repeats=2)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["feature"]: r["importance"] for r in out.collect()}
    assert got["a"] > 0.3 and got["b"] == 0


def test_small_join_broadcasts_only_checked_sizes(spark):
    from oddrows.session import small_join

    big, small = spark.range(100), spark.range(50).withColumn("v", F.lit(1))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small_join(big, small, "id"))
    spark.conf.set("spark.oddrows.broadcastRows", "20")
    try:
        joined = small_join(big, small, "id")
        assert "BroadcastHashJoin" not in plan(joined) and joined.filter("v = 1").count() == 50
    finally:
        spark.conf.unset("spark.oddrows.broadcastRows")
