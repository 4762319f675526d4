"""Raw emails to the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, missing, sender, text
from ..operators.dedup import dedup_keep_first
from ..operators.lookup import flag_members

INPUT_COLUMNS = ["email_id", "sender", "date", "subject", "body", "label", "urls"]
# The exported columns, in their order.
EXPORT_COLUMNS = [
    "subject_clean",
    "body_clean",
    "subject_capitalized_percentage",
    "body_capitalized_percentage",
    "body_word_count",
    "subject_word_count",
    "sender_tld",
    "is_weekend",
    "is_night",
    "is_known_domain",
    "is_known_fortune_domain",
    "total_char_count",
    "symbol_count",
    "symbol_ratio",
    "repeating_symbol_count",
    "email_text_clean",
    "urls",
    "label",
]


def with_sender_parts(df: DataFrame) -> DataFrame:
    """Add sender_clean, sender_email, sender_domain and sender_tld, one projection each."""
    df = df.withColumn("sender_clean", sender.clean_sender(F.col("sender")))
    df = df.withColumn("sender_email", sender.sender_email(F.col("sender_clean")))
    df = df.withColumn("sender_domain", sender.sender_domain(F.col("sender_email")))
    return df.withColumn("sender_tld", sender.sender_tld(F.col("sender_domain")))


def with_text_stats(df: DataFrame) -> DataFrame:
    """Add counts and shares, all of the raw subject and body."""
    subject, body = (F.coalesce(F.col(c), F.lit("")) for c in ("subject", "body"))
    df = df.withColumns(
        {
            "subject_capitalized_percentage": text.capital_share(subject),
            "body_capitalized_percentage": text.capital_share(body),
            "body_word_count": text.word_count(body),
            "subject_word_count": text.word_count(subject),
            "raw_email_text": text.joined(F.col("subject"), F.col("body")),
        }
    )
    raw = F.col("raw_email_text")
    df = df.withColumns(
        {
            "total_char_count": F.length(raw),
            "symbol_count": text.symbol_count(raw),
            "repeating_symbol_count": text.repeated_symbol_runs(raw),
        }
    )
    return df.withColumn("symbol_ratio", text.symbol_ratio(F.col("symbol_count"), F.col("total_char_count")))


def with_date_features(df: DataFrame) -> DataFrame:
    """Add datetime (UTC instant), day_of_week, is_weekend and is_night."""
    df = df.withColumn("datetime", dates.parse_date(dates.strip_date(F.col("date"))))
    at = F.col("datetime")
    return df.withColumns(
        {
            "day_of_week": dates.day_of_week(at),
            "is_weekend": dates.is_weekend(at),
            "is_night": dates.is_night(at),
        }
    )


def with_clean_text(df: DataFrame, mojibake: str = "as_listed") -> DataFrame:
    """Add subject_clean, body_clean and email_text_clean."""
    df = text.clean_text(df, {"subject": "subject_clean", "body": "body_clean"}, mojibake)
    both = text.joined(F.col("subject_clean"), F.col("body_clean"))
    return df.withColumn("email_text_clean", F.nullif(both, F.lit("")))


def with_known_domains(df: DataFrame, top_domains: DataFrame, fortune_domains: DataFrame) -> DataFrame:
    """Add is_known_domain and is_known_fortune_domain for lists with a column `domain`."""
    df = flag_members(df, "sender_domain", top_domains, "domain", "is_known_domain")
    return flag_members(df, "sender_domain", fortune_domains, "domain", "is_known_fortune_domain")


def clean_emails(
    emails: DataFrame,
    top_domains: DataFrame,
    fortune_domains: DataFrame,
    mojibake: str = "as_listed",
    sentinel: bool = False,
) -> DataFrame:
    """The cleaned table: email_id and the exported columns.

    One shuffle, for the duplicates; everything after it is row by row next to two lookup joins.
    `sentinel=True` writes missing text as "NaN" instead of NULL.
    """
    # columns that are not needed, such as the receiver, stay out of the shuffle
    used = emails.select(*[c for c in INPUT_COLUMNS if c in emails.columns])
    df = dedup_keep_first(used, ["subject", "body"])
    df = with_known_domains(with_sender_parts(df), top_domains, fortune_domains)
    df = with_clean_text(with_date_features(with_text_stats(df)), mojibake)
    df = missing.with_default(df, "urls", missing.SENTINEL if sentinel else None)
    if sentinel:
        texts = ("subject_clean", "body_clean", "email_text_clean", "sender_tld")
        df = df.withColumns({c: missing.null_to_sentinel(F.col(c)) for c in texts})
    df = df.withColumn("label", missing.strict_label(F.col("label")))
    return df.select("email_id", *EXPORT_COLUMNS)
