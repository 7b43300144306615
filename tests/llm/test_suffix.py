"""Removal of repeated strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from oddrows.llm import queries, suffix


def brute(texts, order, keep_first, length=400):
    """Mask of removed bytes of each text; ``order`` ranks the texts."""
    seen = {}
    for k in sorted(range(len(texts)), key=order.__getitem__):
        for s in range(len(texts[k]) - length + 1):
            seen.setdefault(texts[k][s : s + length], []).append((k, s))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places[keep_first:]:
                masks[k][s : s + length] = True
    return masks


def sample(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéñ") for _ in range(draw.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(70), prose(130), "ha " * 200, "x" * 450]
    texts = [prose(draw.randint(1, 200)) + draw.choice(passages)[: draw.randint(380, 900)] + prose(draw.randint(0, 50)) for _ in range(25)]
    texts += ["", None, "short", texts[0], texts[0], "y" * 399, "y" * 400, "z" * 401, "漢" * 300, passages[1] * 3]
    return [(100 - k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("chunk, block", [(suffix.CHUNK, suffix.BLOCK), (150, 700)])
def test_every_copy_goes(documents, monkeypatch, chunk, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, chunk))
    rows = sample(1)
    data = [(t or "").encode() for _, t in rows]
    masks = brute(data, list(range(len(rows))), False)
    got = {r["doc_id"]: r for r in suffix.removal_digests(documents(rows)).collect()}
    assert sum(m.any() for m in masks) > 15
    for (i, _), d, m in zip(rows, data, masks):
        kept = bytes(np.frombuffer(d, np.uint8)[~m])
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()), i


def test_the_first_copy_stays(documents):
    rows = sample(2)
    data = [(t or "").encode() for _, t in rows]
    # the least id comes first
    masks = brute(data, [i for i, _ in rows], True)
    df = documents(rows)
    out = suffix.without_later_copies(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    for (i, t), d, m in zip(rows, data, masks):
        kept = bytes(np.frombuffer(d, np.uint8)[~m]).decode("utf-8", "ignore")
        assert got[i]["text"] == (None if t is None else kept)
        assert got[i]["n_chars"] == (None if t is None else len(kept))


def test_null_ids_repeated_rows_and_empty_table(documents):
    draw = random.Random(5)
    long = "".join(draw.choice("abcdefgh") for _ in range(600))
    rows = [(None, long), (4, long), (4, long), (8, "tail " + long[:450])]
    out = sorted(((r["doc_id"] or -1, r["text"]) for r in suffix.without_later_copies(documents(rows)).collect()), key=repr)
    assert out == sorted([(-1, ""), (4, long), (4, long), (8, "tail ")], key=repr)
    assert [r["n_removed"] for r in suffix.removal_digests(documents(rows)).orderBy("n_bytes", "doc_id").collect()] == [450, 600, 600, 600]
    assert suffix.removal_digests(documents([])).collect() == [] and suffix.without_later_copies(documents([])).collect() == []


def test_runs_name_equal_windows_alike():
    draw = np.random.default_rng(3)
    passage = draw.integers(0, 256, 900, dtype=np.uint8)
    a = np.concatenate([draw.integers(0, 256, 333, dtype=np.uint8), passage])
    b = np.concatenate([draw.integers(0, 256, 71, dtype=np.uint8), passage, draw.integers(0, 256, 9, dtype=np.uint8)])

    def bucket(data):
        found = {}
        for hashes, first, count, _ in suffix.runs_of(data, 400):
            for h, s, n in zip(hashes, first, count):
                found.update({int(s) + k: int(h) for k in range(n)})
        assert sorted(found) == list(range(len(data) - 399))
        return found

    x, y = bucket(a), bucket(b)
    assert all(x[333 + k] == y[71 + k] for k in range(501))


def test_op7_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    data = [(t or "").encode() for _, t in rows]
    masks = brute(data, list(range(len(rows))), False)
    got = {r["doc_id"]: r["kept_sha256"] for r in queries.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~m])).hexdigest() for (i, _), d, m in zip(rows, data, masks)}


def test_longest_previous_factors():
    draw = np.random.default_rng(4)
    for depth in (3, 8, 21, 64):
        data = np.concatenate([draw.integers(97, 99, 150, dtype=np.uint8), np.full(90, 97, np.uint8), np.tile(draw.integers(97, 123, 40, dtype=np.uint8), 4)])
        starts = np.arange(len(data) - depth + 1)
        places = draw.permutation(len(starts))
        best, source = suffix.longest_previous(data, starts, places, depth)
        raw = data.tobytes()
        for i in starts:
            want = 0
            for j in starts[places < places[i]]:
                size = 0
                while size < depth and raw[i + size] == raw[j + size]:
                    size += 1
                want = max(want, size)
            assert best[i] == want
            if want:
                assert places[source[i]] < places[i] and raw[i : i + want] == raw[source[i] : source[i] + want]


def test_nearest_smaller():
    values = np.random.default_rng(5).permutation(300)
    before, after = suffix.nearest_smaller(values)
    for k, v in enumerate(values):
        assert before[k] == max([j for j in range(k) if values[j] < v], default=-1)
        assert after[k] == min([j for j in range(k + 1, 300) if values[j] < v], default=300)


@pytest.mark.parametrize("keep_first", [True, False])
def test_hot_passage_over_many_tasks(documents, keep_first):
    draw = random.Random(8)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = prose(620)
    rows = [(k, prose(draw.randint(0, 300)) + passage + prose(draw.randint(0, 90))) for k in range(60)] + [(k, prose(500)) for k in range(60, 70)]
    data = [t.encode() for _, t in rows]
    masks = brute(data, [i for i, _ in rows], keep_first)
    texts = suffix.keyed(documents(rows + rows[:3]))
    spans = {r["key"]: suffix.merged([(s["start"], s["end"]) for s in r["spans"]]) for r in suffix.repeated_spans(texts, keep_first, 400, 300).collect()}
    for d, m in zip(data, masks):
        mask = np.zeros(len(d), bool)
        for a, b in spans.get(hashlib.md5(d).hexdigest(), []):
            mask[a:b] = True
        assert (mask == m).all()


def test_short_lengths(documents):
    rows = [(1, "abcdefgh-12345"), (2, "xx abcdefgh yy"), (3, "zzabcdefg")]
    got = {r["doc_id"]: r["text"] for r in suffix.without_later_copies(documents(rows), 7).collect()}
    assert got == {1: "abcdefgh-12345", 2: "xx  yy", 3: "zz"}
