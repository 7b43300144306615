"""Links between vectors and between texts against brute force."""

import random

import numpy as np
import pytest

from oddrows.llm import embeddings, jaccard, queries

VECTORS = "vec_id long, embedding array<float>, label int, key string, n_links int"


def components_of(ids, linked):
    """Least reachable id of each place, from a function that lists neighbours."""
    label = list(range(len(ids)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(ids)):
        for j in linked(k):
            a, b = top(k), top(j)
            label[max(a, b)] = min(a, b)
    parts = {}
    for k in range(len(ids)):
        parts.setdefault(top(k), []).append(k)
    return {k: min((ids[j] for j in part if ids[j] is not None), default=None) for part in parts.values() for k in part}


def vector_rows(seed, n, groups):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 16))
    rows = [v.tolist() for v in x]
    for g in range(groups):
        for _ in range(draw.integers(1, 30)):
            rows.append((x[g] + 0.15 * draw.normal(size=16)).tolist())
    rows += [rows[0], rows[0], [2 * v for v in rows[1]], [0.0] * 16, None, [], [1.0] * 3, [1.0, 1.0, 1.0], [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    return [(k * 3 % (7 * len(rows)), [float(np.float32(v)) for v in r] if r is not None else None) for k, r in enumerate(rows)]


def brute(rows):
    usable = [k for k, (_, v) in enumerate(rows) if v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in usable}
    near = {k: [j for j in usable if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9] for k in usable}
    return near, components_of([i for i, _ in rows], lambda k: near.get(k, []))


@pytest.mark.parametrize("chunk, cell", [(4096, 1024), (8, 4)])
def test_vectors(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = vector_rows(1, 150, 6)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS).repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    near, part = brute(rows)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    every = sum(map(len, near.values()))
    assert every > 300 and 0.97 * every <= found <= every
    for k, (i, _) in enumerate(rows):
        assert got[i]["n_links"] <= len(near.get(k, []))
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    if chunk == 4096:
        # one cell: nothing can be missed
        assert {i: got[i]["component_id"] for i, _ in rows} == {rows[k][0]: p for k, p in part.items()}
        assert found == every


def test_vectors_null_ids_and_empty_table(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [0.0, 1.0]), (None, None)]
    out = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in out) == [(-1, 0, -1, True), (-1, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_visits_follow_the_distance():
    draw = np.random.default_rng(2)
    grid = embeddings.MultiIndex(draw.normal(size=(7, 4)), draw.normal(size=(5, 4)), 9)
    x = draw.normal(size=(20, 8))
    cost = (embeddings.squares(x[:, :4], grid.left)[:, :, None] + embeddings.squares(x[:, 4:], grid.right)[:, None, :]).reshape(20, -1)
    for visits in (1, 2, 9, 35):
        assert (grid.cells(x, visits) == np.argsort(cost, 1, kind="stable")[:, :visits]).all()


def texts(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 120))) for _ in range(n)]
    for k in range(12):
        base = made[k].split()
        for _ in range(draw.randint(0, 12)):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            made.append((" " if draw.random() < 0.5 else "\n").join(copy))
    made += ["", "", None, " \n ", "one", "one", " one", "a b c", "a  b c", " ".join(words * 60), " ".join(words * 60 + ["x"])]
    return made


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard_brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = {}
    for k, a in enumerate(sets):
        near[k] = [j for j, b in enumerate(sets) if j != k and a and b and 10 * len(a & b) >= 8 * len(a | b)]
    return near


@pytest.mark.parametrize("chunk", [500_000, 600])
def test_texts(documents, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [(2 * k + 1, t) for k, t in enumerate(texts(4))]
    near = jaccard_brute(rows)
    part = components_of([i for i, _ in rows], near.get)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(rows)).collect()}
    assert len(got) == len(rows)
    assert sum(map(len, near.values())) > 100
    for k, (i, _) in enumerate(rows):
        assert (got[i]["n_links"], got[i]["group_id"], got[i]["kept"]) == (len(near[k]), part[k], part[k] == i), rows[k]


def test_one_document_of_a_group_stays(documents):
    base = " ".join(f"v{k}" for k in range(60))
    rows = [(7, base), (3, base + " end"), (3, base + " end"), (None, base), (9, "other text of its own with words"), (1, ""), (1, ""), (2, None)]
    df = documents(rows)
    left = jaccard.one_per_group(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(3, base + " end"), (9, rows[4][1]), (1, ""), (1, ""), (2, None)], key=repr)
    assert jaccard.one_per_group(documents([])).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    # the tail of a pair with few matches is below the tolerance, one more match is not
    assert jaccard.NEEDED == sorted(jaccard.NEEDED)
    draw = np.random.default_rng(7)
    kept = 0
    for _ in range(300):
        both = draw.integers(0, 2**62, 170, dtype=np.uint64)
        a = np.unique(np.concatenate([both, draw.integers(0, 2**62, 20, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, draw.integers(0, 2**62, 20, dtype=np.uint64)]))
        kept += jaccard.survivors(jaccard.signature(a)[None], jaccard.signature(b)[None], np.ones((1, 1), bool))[0, 0]
    assert kept == 300
    far = [jaccard.signature(draw.integers(0, 2**62, 100, dtype=np.uint64)) for _ in range(2)]
    assert not jaccard.survivors(far[0][None], far[1][None], np.ones((1, 1), bool)).any()


def test_op1_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    near, part = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op1_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (len(near[k]), part[k]) for k, (i, _) in enumerate(rows)}
