"""Feature blocks and feature sets."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The twelve numeric features of a cleaned email, in their order.
TABULAR = [
    "subject_capitalized_percentage",
    "body_capitalized_percentage",
    "body_word_count",
    "subject_word_count",
    "is_weekend",
    "is_night",
    "is_known_domain",
    "is_known_fortune_domain",
    "total_char_count",
    "symbol_count",
    "symbol_ratio",
    "repeating_symbol_count",
]
# The names of the feature sets.
FEATURE_SETS = ("pure_bert", "pure_tfidf", "fused")


def block_columns(feature_set: str) -> list[str]:
    """The blocks of a feature set, in order: vector columns but for the tabular ones."""
    blocks = {
        "pure_bert": ["embedding_vector"],
        "pure_tfidf": ["tfidf"],
        "fused": [*TABULAR, "tfidf", "embedding_vector"],
    }
    if feature_set not in blocks:
        raise ValueError(f"unknown feature set {feature_set!r}: choose from {FEATURE_SETS}")
    return blocks[feature_set]


def embedding_as_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("embedding_vector", array_to_vector(F.col(embedding).cast("array<double>")))


def fuse(df: DataFrame, feature_set: str, out: str = "features") -> DataFrame:
    """Put the blocks side by side into one vector; sparse where that is shorter."""
    return VectorAssembler(inputCols=block_columns(feature_set), outputCol=out).transform(df)
