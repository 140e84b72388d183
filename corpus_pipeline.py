"""Corpus preparation in five stages, from raw documents to packed token sequences.

Each stage is a function of ``(spark, docs, sf_dir)`` and sees only what the stage before kept; its result is
written as Parquet in the cluster's shared folder and read again, so a lost executor repeats one stage.
All stages but the last return the columns of ``documents``; every stage accepts further columns, nulls,
empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trialweave.llm.common import table
from trialweave.llm.decontaminate import without_contaminated
from trialweave.llm.ngram_join import keep_one_of_each
from trialweave.llm.packing import pack_documents
from trialweave.llm.secret_scan import redact_secrets
from trialweave.llm.toxicity import train_toxicity, without_toxic
from trialweave.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the machine fitted on their labels scores at 0.5 or more."""
    return without_toxic(docs.select(COLUMNS), train_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked at a five-gram Jaccard similarity of 0.8."""
    return keep_one_of_each(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which ten consecutive words of a benchmark item occur."""
    return without_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document goes."""
    return redact_secrets(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids along the curve, one row for each piece of a document."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL expresses neither the fitted machine nor the tokenizer; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
