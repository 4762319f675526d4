"""Embedding tables: Parquet with (row id, label, embedding array<float>)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, row_id: str = "email_id", mode: str = "error") -> None:
    df.select(
        row_id, F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")
    ).write.mode(mode).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Raises when the path does not exist, or lacks a column."""
    df = spark.read.parquet(path)
    missing = {"label", "embedding"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} has no column {sorted(missing)}")
    return df
