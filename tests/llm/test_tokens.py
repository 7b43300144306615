"""Byte-level BPE and token counts against the libraries, on odd texts and whole tables."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from oddrows.llm import bpe, counts, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
MODEL = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def odd_texts():
    draw = random.Random(3)
    parts = ["a", "ab", " ", "  ", "\n", "'s", "é", "1", "½", "漢", "\x1c", "\xa0", "%", "ABC", "ʰ", "Ⅷ", "the", "ing", "▁", "\t", "=", "-", "ñ", "٣", "👩‍👧", "<s>", "\x00"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 120))) for _ in range(300)]
    return ["", None, "a" * 5000, "  a  b ", "<|endoftext|> <unk> </s><0x0A>", "x" * 70_000 + " y" * 30_000, "abababab" * 40, *made]


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_bpe_is_the_librarys(documents, encoding):
    texts = odd_texts()
    docs = documents(list(enumerate(texts)) + [(0, "")])
    coded = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == encoding.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_bpe_forgets_and_blocks_without_change(documents, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "MEMORY", 5)
    texts = odd_texts()[7:60]
    for r in bpe.encode(documents(list(enumerate(texts))), RANKS, P.PATTERN).collect():
        assert r["ids"] == encoding.encode_ordinary(texts[r["doc_id"]])


def test_bpe_merges_a_made_pair_of_lower_rank_first():
    # "aba" has a lower rank than "ab": it must be made before the second "ab" is
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"aba": 0, b"ab": 1, b"bc": 2}
    tokens = {r: t for t, r in ranks.items()}
    early = bpe.reaches_below(ranks)
    assert 1 in early
    made = bpe.replay([b"abab", b"ababab", b"xbc", b""], ranks, tokens, early)
    named = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    got = [np.frombuffer(x, np.int32).tolist() for x in made]
    assert got == [named.encode_ordinary(w) for w in ("abab", "ababab", "xbc", "")]


def test_bpe_empty_table(documents):
    assert bpe.token_digests(documents([]), RANKS, P.PATTERN).collect() == []


def test_op5_whole_table(spark, encoding):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), digest(",".join(map(str, ids)).encode()), digest((r["text"] or "").encode()))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op5_byte_bpe(spark, SF).collect()}
    assert got == want


def test_counts_are_the_librarys(documents):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    rows = counts.token_counts(documents(list(enumerate(texts)) + [(None, "a b"), (None, "a b")]), MODEL).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_counts_forget_without_change(documents, monkeypatch):
    monkeypatch.setattr(counts, "MEMORY", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()[7:60]
    for r in counts.with_token_count(documents(list(enumerate(texts))), MODEL).collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]]))
    assert counts.token_counts(documents([]), MODEL).count() == 0


def test_op9_whole_table(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {r["doc_id"]: len(model.encode(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_counts(spark, SF).select("doc_id", F.col("n_tokens")).collect()} == want
