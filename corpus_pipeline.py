"""From raw documents to token ids: five stages, each one operator of lumenframe.llm at its production parameters.

The near-duplicate stage is the general form of its operator: five-word shingles at a similarity of 0.8 or more (op5's query has
three words and two bits by its own contract).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, exact, langid, mixing, simhash
from lumenframe.llm.runtime import checkpoint


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a fair score; those without a letter go."""
    return langid.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near texts, the document with the least id."""
    return simhash.without_near_texts(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as it is taken."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again as a check."""
    return bpe.tokenized(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("byte_bpe", tokens),
]

#: Language ID, SimHash components and BPE have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are checkpointed, so no stage is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else checkpoint(docs), sf_dir)
    return docs
