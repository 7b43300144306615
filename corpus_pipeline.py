"""From raw documents to token ids, stage by stage; each stage works on all that the one before kept.

A stage takes the session, the documents and the folder of the tables. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrows.llm import bpe, decontaminate, jaccard, suffix, toxicity
from oddrows.llm.common import discard, save, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "score")
    return toxicity.with_toxicity(docs, model, score=score).where(F.col(score) < 0.3).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a word 5-gram Jaccard similarity of 0.8 or more tie together."""
    return jaccard.one_per_group(docs)


# Bytes of a passage that the suffix stage cuts: below those of 51 words in any language of the corpus.
PASSAGE = 250


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE`` bytes or more that stand earlier in the corpus are cut out of the texts."""
    return suffix.without_later_copies(docs, PASSAGE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and of the bytes decoded from them, per document that is left."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("suffix", cut_repeats),
    ("decontamination", drop_leaks),
    ("tokens", tokens),
]

# The toxicity model has no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again before the next, and removed after it."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
