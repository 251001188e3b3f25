"""A corpus from raw documents to packed sequences: language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; run()
writes each stage's result in the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import langid, neardup, packing, secrets
from orrery.llm.common import fixed_table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts, texts without letters and texts that no learned language explains go.
    Without labels to learn from, only texts without letters go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (runs of five words, similarity of 0.8 or more), that with the least doc_id."""
    return neardup.drop_duplicates(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a sequence of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))[1]


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("pack", pack)]

#: Cross-parsing, signatures and the search for fillings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixed_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
