"""From raw documents to token ids, stage by stage.

Each stage works on all rows that its predecessor kept, and hands on the columns of documents; the
last one returns token ids. The stages are the operators of the library with their own parameters;
near-duplicates are found on shingles of five words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import byte_bpe, cotraining, mixing, pii, simhash
from tidegauge.llm.common import read, small_batches
from tidegauge.session import configure, spool


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    return cotraining.keep_good(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return simhash.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    small_batches(spark)
    return pii.mask_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    small_batches(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and token ids of every row."""
    small_batches(spark)
    return byte_bpe.encode(docs)


STAGES = [("quality_classifier", classify), ("simhash", deduplicate), ("pii", redact), ("mixing", mix),
          ("byte_bpe", encode)]
#: The stages are no SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next one reads it."""
    configure(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = spool(docs)
    return docs
