"""A corpus from raw documents to token ids: filter, drop near duplicates, mask personal data, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailsift.llm import mixing, neighbours, personal, pieces, quality
from mailsift.llm.common import table
from mailsift.session import write_and_read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return neighbours.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return personal.mask(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and what is known of them, for each document of the mix."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before has kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashed n-grams, near-duplicate search and tokens are beyond SQL: the tests compare run() with a brute-force version.
ORACLE_SQL = None
