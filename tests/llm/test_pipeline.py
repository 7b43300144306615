"""The stages one by one against brute force, and the whole run."""

import hashlib

import corpus_pipeline as pipeline
from tests.llm.test_near_duplicates import components_of, jaccard_brute
from tests.llm.test_suffix import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "suffix", "decontamination", "tokens"]
    rows = {}
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        rows[name + " in"] = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, SF).toPandas()
        assert list(out.columns) == columns
        now = spark.createDataFrame(out, docs.schema)
        rows[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start = rows["toxicity in"]
    gone = start.keys() - rows["toxicity"].keys()
    # a few dozen labels make a rough model; accuracy is tested on larger tables
    assert sum(toxic.get(i) == 0 for i in gone) <= 0.05 * len(start)
    assert sum(toxic.get(i) == 1 for i in gone) >= 0.5 * sum(toxic.get(i) == 1 for i in start)
    # one document of each group, the one of the least id
    pairs = sorted(rows["jaccard in"].items())
    part = components_of([i for i, _ in pairs], jaccard_brute(pairs).get)
    assert rows["jaccard"].keys() == {part[k] for k in range(len(pairs))}
    # later copies of long strings
    pairs = sorted(rows["suffix in"].items())
    data = [(t or "").encode() for _, t in pairs]
    masks = brute(data, list(range(len(pairs))), True, pipeline.PASSAGE)
    want = {i: bytes(b for b, m in zip(d, mask) if not m).decode("utf-8", "ignore") for (i, _), d, mask in zip(pairs, data, masks)}
    assert rows["suffix"] == want
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = rows["decontamination"]
    assert not [i for i, t in left.items() if any(b in t for b in bench)]
    assert all(rows["decontamination in"][i] == t for i, t in left.items())
    for i in rows["decontamination in"].keys() - left.keys():
        words = rows["decontamination in"][i].lower().split()
        held = {" ".join(words[k : k + 5]) for k in range(len(words))}
        assert any(" ".join(b.lower().split()[k : k + 5]) in held for b in bench for k in range(len(b.split()) - 4))


def test_run(spark):
    out = pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(out) < len(docs)
    untouched = sum(r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest() for r in out)
    assert untouched > 0.5 * len(out)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns named like the stages' own."""
    prose = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank and sing"
    rows = [
        (1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, prose + " twice", "en", None, None), (3, None, None, None, None), (3, None, None, None, None),
        (4, "", "en", "b", 0), (None, None, None, None, None), (None, "a text without an id", "en", "b", 20), (5, "漢字" * 30_000, "zh", "c", 60_000),
        (6, " \t\n", "en", "c", 3), (7, "one", "en", "c", 3),
    ]
    extra = ["score", "key", "first", "spans", "leak", "in0", "own", "root", "KEY_", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "which of these rivers is the longest in the whole world"), (None, None), (2, "")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert all(list(r)[5:] == extra for r in now.collect()), name
    # one row is left of the repeated one; the second text is within the similarity of the first
    assert sorted(str(r["doc_id"]) for r in now.collect()) == sorted(["1", "3", "3", "4", "None", "None", "5", "6", "7"])
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == 9 and all(r["n_tokens"] == 0 for r in out if r["doc_id"] in (3, 4))
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
