"""From raw documents to packed training sequences: five operators, one after another.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last
returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brambling.llm import cotraining, hyperminhash, language_id, packing, pii_feistel
from brambling.llm.common import checkpointed, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return cotraining.keep_good(docs, cotraining.train(docs, documents(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return language_id.keep_identified(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return hyperminhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal data."""
    return pii_feistel.pseudonymise(docs, pii_feistel.TEST_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packed),
]
#: Learned models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
