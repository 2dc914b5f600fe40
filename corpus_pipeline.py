"""A corpus from documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return
the columns of documents. Between stages rows are written as Parquet to the shared folder and read again, so a
stage restarts from files whatever executors are lost.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rill.llm import mixing, packing, quality, secrets, simhash
from rill.llm.common import dropped, saved
from rill.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or the learned decision list rejects."""
    return quality.keep_good(docs, quality.fit_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of near duplicates."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.mask_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's words up to its target: documents come out not at all, cut, once or up to three times."""
    return mixing.take_words(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs all texts into sequences of tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: SimHash fingerprints, the learned rules and token ids have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from `documents` on. A stage's table is removed once the next one's is written; packing
    writes what it needs of the last one before it returns."""
    docs, former = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if former is not None:
            dropped(former)
        former = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    dropped(former)
    return packed
