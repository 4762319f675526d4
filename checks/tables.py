"""Email-shaped tables derived from the given ones; the oracle SQL spells out the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import spread

HOST = r"https?://([^/]+)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emails(spark: SparkSession, sf: str) -> DataFrame:
    """documents as emails: senders from all pages in turn, dates from events, labels from labels."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars"))
    pages = table(spark, sf, "pages")
    n_pages = pages.agg(F.max("page_id") + 1).first()[0]
    p = pages.groupBy("page_id").agg(F.min(F.regexp_extract("url", HOST, 1)).alias("host"))
    e = table(spark, sf, "events").select("event_id", "ts")
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("label"))
    joined = (
        d.join(p, F.col("page_id") == F.col("doc_id") % n_pages, "left")
        .join(e, F.col("event_id") == F.col("doc_id"), "left")
        .join(lab, F.col("label_id") == F.col("doc_id"), "left")
    )
    source, host, i = F.col("source"), F.col("host"), F.col("doc_id")
    sender = (
        F.when(i % 11 == 0, F.concat(source, F.lit(" < >")))
        .when(host.isNull(), F.lit(""))
        .when(i % 5 == 0, F.concat(source, F.lit("@"), host))
        .otherwise(F.concat(source, F.lit(" <"), source, F.lit("@"), host, F.lit(">")))
    )
    zone = (
        F.when(i % 4 == 0, F.lit(" +0000"))
        .when(i % 4 == 1, F.lit(" +0000 (UTC)"))
        .when(i % 4 == 2, F.lit(" -0700"))
        .otherwise(F.lit(" GMT"))
    )
    line_end = F.locate("\n", F.col("text"))
    return joined.select(
        i.alias("email_id"),
        sender.alias("sender"),
        F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), zone).alias("date"),
        F.substring_index("text", "\n", 1).alias("subject"),
        F.when(line_end > 0, F.expr("substring(text, locate('\\n', text) + 1)")).otherwise(F.lit("")).alias("body"),
        "label",
    )


def domain_list(spark: SparkSession, sf: str, ending: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", HOST, 1).alias("domain"))
    return hosts.where(F.endswith("domain", F.lit(ending))).distinct()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score that needs no model: (email_id, label, prob)."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")).where("label IS NOT NULL")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("email_id"), "label", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("prob")
    )


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings with a binary label and a cluster that needs no model."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "embedding",
        (F.col("label") >= 5).cast("int").alias("label"),
        (F.element_at("embedding", 1) > 0).cast("int").alias("cluster"),
    )


def labelled_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
