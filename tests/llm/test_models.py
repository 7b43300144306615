"""Quality and toxicity: accuracy on rows held out, rules against direct evaluation, decoding against all readings."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from oddrows.llm import lasso, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out_counts(spark, rows, label, modulus, remainder):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = {(y, p): 0 for y in (0, 1) for p in (0, 1)}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in labels:
            counts[labels[r["doc_id"]], r["predicted"]] += 1
    return counts


def test_op2_held_out(spark):
    rows = queries.op2_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    counts = held_out_counts(spark, rows, "quality", 5, 0)
    assert counts[1, 0] + counts[0, 1] <= 0.01 * sum(counts.values())


def test_op3_held_out(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    counts = held_out_counts(spark, rows, "toxic", 4, 2)
    assert counts[1, 1] >= 0.9 * (counts[1, 0] + counts[1, 1])
    assert counts[0, 1] <= 0.01 * (counts[0, 0] + counts[0, 1])


def test_rules_are_compiled_as_they_are(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"], trees=10)
    assert 0 < len(model.rules) < 60
    rows = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double, c double").select("a", "b", "c", model.score().alias("s")).collect()
    right = 0
    for r in rows:
        total = model.intercept + sum(w for rule, w in model.rules if all((r[s] > cut) == above for s, cut, above in rule))
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
        right += (r["s"] >= 0.5) == ((r["a"] > 0.2) and (r["b"] < 0.5))
    assert right >= 580


def test_lasso_meets_its_conditions():
    draw = np.random.default_rng(2)
    x = (draw.random((500, 12)) < 0.4).astype(float)
    y = (draw.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    b, w = lasso.fit_lasso(x, y, 0.02, steps=2000)
    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert 0 < (w != 0).sum() < 12
    assert np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-3)
    assert (np.abs(slope[w == 0]) <= 0.021).all()
    assert lasso.fit_lasso(np.zeros((0, 3)), np.zeros(0), 0.1)[0] == 0


def letters_of(texts):
    counts = np.zeros((toxicity.SIZE,) * 3, np.int64)
    for t in texts:
        for word in t.split():
            codes = [0, 0, *map(toxicity.letter_code, word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                counts[a, b, c] += 1
    return toxicity.LetterModel(counts)


def test_decoding_finds_the_cheapest_reading():
    model = letters_of(["idiot stupid trash loser aaa"] * 50)

    def cost(letters):
        codes = [0, 0, *map(toxicity.letter_code, letters), 0]
        return sum(model.cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    for word in ("1d10t", "5tup!d", "l0-5er", "tr@sh", "st.up.id"):
        readings = []
        for c in word:
            some = [(0.0, c)] if c.isalpha() else []
            some += [(toxicity.LOOK, x) for x in toxicity.LOOKS.get(c, "")]
            some += [(toxicity.DROP, "")] if c in toxicity.SEPARATORS or not some else []
            readings.append(some)
        best = min((sum(p for p, _ in path) + cost("".join(x for _, x in path)), "".join(x for _, x in path)) for path in itertools.product(*readings))
        assert model.decode(word) == best[1]
    assert [model.restore_word(w) for w in ("1d10t!!", "$tup1d,", "stuuuupid", "l.o.s.e.r", "Trash.", "plain", "123", "")] == ["idiot", "stupid", "stupid", "loser", "trash", "plain", "123", ""]
    assert "idiot" in model.restore("an i d i o t here").split()
    assert model.restore(None) == ""


def test_letter_counts_cover_all_rows(documents):
    texts = ["idiot ab", "ab", None, "", "x1y éé 漢"]
    counts = toxicity.letter_counts(documents(list(enumerate(texts))))
    code = toxicity.letter_code
    assert counts[0, code("a"), code("b")] == 2 and counts[code("a"), code("b"), 0] == 2
    assert counts[code("d"), code("i"), code("o")] == 1
    assert counts[0, code("é"), code("é")] == 1


def test_obfuscated_words_are_caught(spark, documents):
    draw = random.Random(1)
    syllables = ["the", "on", "er", "ti", "an", "in", "sh", "re"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    bad = ["idiot", "stupid", "loser"]
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(30)]
        if k % 5 == 0:
            words[draw.randrange(30)] = draw.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, k, int(k % 5 == 0)))
    marked = [(1000, "the on 1d10t ertian"), (1001, "re $tup1d"), (1002, "an l o s e r in"), (1003, "the on ertian 10 on 5"), (1004, ""), (1005, None), (None, "stuuupid")]
    known = spark.createDataFrame(labels + [(1003, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(documents(rows + marked), known).collect()
    got = {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert got == {1000: 1, 1001: 1, 1002: 1, 1003: 0, 1004: 0, 1005: 0, None: 1}
    assert all(not r["held_out"] for r in rows if r["doc_id"] is None)


def test_spaced_words_beside_short_ones(spark, documents):
    filler = "you are a person who will often go to an old house and then it is up to us".split()
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choices(filler, k=25) + (["stupid" if k % 2 else "idiot"] if k % 5 < 2 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, 0, int(k % 5 < 2)) for k in range(400)], "doc_id long, quality int, toxic int")
    said = ["you are a s t u p i d person", "what a i d i o t", "y o u i d i o t", "go s  t  u  p  i  d then", "st up id person", "a s t u p i d!", "(i d i o t), then", "a s t u p ! d person"]
    fine = ["it is up to us", "a p e r s o n", "go to an old house", "1 2 3 4 a 5", "h o u s e"]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(documents(rows + list(enumerate(said + fine, 1000))), labels).collect()}
    assert [got[1000 + k] for k in range(len(said + fine))] == [1] * len(said) + [0] * len(fine)


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_few_or_no_labels(spark, documents, scores):
    docs = documents([(1, "a b c"), (1, "a b c"), (2, None), (None, ""), (3, "x" * 200_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = scores(docs, ones).collect()
    assert len(got) == 5 and all(0.5 < r["score"] < 1 for r in got)
    assert scores(documents([]), ones).collect() == []


def test_statistics_of_odd_texts():
    assert set(quality.statistics_of(None)) == set(quality.statistics_of(" \n ")) == {0.0}
    made = dict(zip(quality.STATISTICS, quality.statistics_of("AB ab ab\n\nab 1! 漢字 |x|")))
    assert made["digits"] == 1 / 15 and made["capital_words"] == 1 / 7 and made["repeated_next"] == 2 / 6


def test_sparse_lasso_finds_the_same_weights(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((600, 12)) < 0.25).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + x[:, 2] - 0.5)))).astype(float)
    rows = [(int(label), [int(k) for k in np.nonzero(r)[0]], 1) for r, label in zip(x, y)]
    df = spark.createDataFrame(rows, "label int, has array<int>, w long")
    want = lasso.fit_lasso(x, y, 0.01, steps=4000)
    got = lasso.fit_sparse_lasso(df, 12, 0.01)
    assert np.allclose(got[0], want[0], atol=2e-3) and np.allclose(got[1], want[1], atol=2e-3)
    assert (got[1][3:] == 0).any() and lasso.fit_sparse_lasso(df.limit(0), 12, 0.01)[0] == 0


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(28_000).selectExpr("id AS doc_id", "concat('plain words ', IF(id % 5 = 0, 'vile', 'kind')) AS text", "CAST(id % 5 = 0 AS INT) AS toxic")
    seen = []
    fit = lasso.fit_sparse_lasso
    monkeypatch.setattr(toxicity, "fit_sparse_lasso", lambda rows, *a: seen.append(rows.agg(F.sum("w")).first()[0]) or fit(rows, *a))
    model = toxicity.fit_toxicity(docs, docs.select("doc_id", "toxic"))
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).count()
    assert seen == [known] and known > 20_000 and model.weights.get("vile", 0) > 0


def odd_texts(count=400):
    draw = random.Random(11)
    signs = "aabbcdeé1$!-.'(,_  \t\n ΣσİA漢　\x00\U0001d4b3"
    made = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(count)]
    return [None, "", " \n", "s t u p i d", "(a) b' ,c, !! ...", "-- a \x1cb c", "ΑΣ Σ α, Σ", "İ a İ b", "aaa (bbb) it is -ccc-", "ab\0c ab\0d ab", "$tup1d (1diot) l.o.s.e.r", "x" * 700_000, *made]


def test_words_found_at_once_are_those_read_one_by_one():
    model = letters_of(["idiot stupid loser aab bad it is"] * 20)
    texts = odd_texts()
    read = toxicity.Remembered(model.restore_word)
    got = list(toxicity.restored_words(model, read, texts))
    assert len(got) == len(texts)
    for text, found in zip(texts, got):
        words = (text or "").split()
        made = ["".join(m[0].split()) for m in toxicity.SPACED.finditer(text or "")]
        for run in toxicity.spaced_runs(words):
            made += model.cheapest(tuple(run))
        assert found == {model.restore_word(w) for w in words + made} - {""}


def test_plain_words_are_not_looked_up():
    model = letters_of(["idiot stupid loser"] * 20)
    read = toxicity.Remembered(model.restore_word)
    assert list(toxicity.restored_words(model, read, ["some plain words, one 1d10t and"])) == [{"some", "plain", "words", "one", "idiot", "and"}]
    assert set(read) == {"words,", "1d10t"}


def test_first_letters_select_the_words_with_weights(spark, documents):
    model = letters_of(["idiot stupid loser aab bad it is"] * 20)
    weights = {"aab*": 1.0, "bad": 2.0, "b": 0.5, "ab\0*": 4.0, "漢": 3.0, "é1": 1.0, "idiot": -2.0, "aé": 0.25}
    texts = odd_texts() + ["Bad, aabc", "b", "b.", "1d10t", "AABCD (aab)", "aa bad"]
    rows = toxicity.with_toxicity(documents(list(enumerate(texts))), toxicity.ToxicityModel(model, -1.0, weights)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        read = set(map(model.restore_word, model.joined_words(texts[r["doc_id"]])))
        total = -1.0 + sum(weights[f] for f in sorted({f for w in read for f in toxicity.word_features(w)} & weights.keys()))
        assert r["score"] == 1 / (1 + math.exp(-total))


def test_feature_counts_are_those_of_every_row():
    draw = random.Random(12)
    rows = [sorted({"".join(draw.choices("aab\0é𝒳", k=draw.randrange(1, 12))) for _ in range(draw.randrange(30))}) for _ in range(60)]
    marks = [draw.random() < 0.3 for _ in rows]
    words = list({w for r in rows for w in r})
    draw.shuffle(words)
    place = {w: k for k, w in enumerate(words)}
    found, ones, zeros = toxicity.feature_counts(words, [np.array([place[w] for w in r], np.int64) for r in rows], marks)
    want = {}
    for r, mark in zip(rows, marks):
        for f in {f for w in r for f in toxicity.word_features(w)}:
            counted = want.setdefault(f, [0, 0])
            counted[not mark] += 1
    assert len(found) == len(set(found)) and {f: [a, b] for f, a, b in zip(found, ones.tolist(), zeros.tolist())} == want
    assert toxicity.feature_counts([], [], [])[0] == []


def test_counts_do_not_depend_on_the_blocks(spark, documents, monkeypatch):
    texts = [" ".join(random.Random(k).choices("idiot Idiots stupid, kind (kinder) vile ab a b c".split(), k=30)) for k in range(120)] + [None, ""]
    docs = documents(list(enumerate(texts)))
    labels = spark.createDataFrame([(k, 0, int("vile" in (t or ""))) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    first = toxicity.fit_toxicity(docs, labels)
    for name, value in (("COUNT_WORDS", 3), ("FEATURE_WORDS", 5), ("BLOCK_SIGNS", 40)):
        monkeypatch.setattr(toxicity, name, value)
    again = toxicity.fit_toxicity(docs, labels)
    assert first.letters.words == again.letters.words and first.weights.keys() == again.weights.keys() and first.weights
    assert all(first.weights[f] == pytest.approx(again.weights[f], abs=1e-9) for f in first.weights)
