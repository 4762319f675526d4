"""Missing values: NULL inside, the text "NaN" at the edges where a reader or writer asks for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import WS

# Fixed value: the text that stands for a missing value in files.
SENTINEL = "NaN"


def from_sentinel(text: Column) -> Column:
    """The whole value "NaN" becomes NULL; text that merely contains it is left alone."""
    return F.nullif(text, F.lit(SENTINEL))


def to_sentinel(text: Column) -> Column:
    """NULL and empty text become "NaN"."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(SENTINEL))


def null_to_sentinel(text: Column) -> Column:
    """NULL becomes "NaN"; empty text stays (a domain may be empty without being missing)."""
    return F.coalesce(text, F.lit(SENTINEL))


def blank_sentinel(text: Column) -> Column:
    """The whole value "NaN" (or NULL) becomes empty text."""
    return F.coalesce(from_sentinel(text), F.lit(""))


def number_or_zero(value: Column) -> Column:
    """Numeric coercion: what does not read as a number becomes 0.

    Java also reads a type suffix ("1d", "2f") and hexadecimal ("0x1p3"); such text is not a number here.
    """
    text = value.cast("string")
    java_only = text.rlike(rf"[0-9.][dDfF][{WS}]*$|[xX]")
    number = F.when(~java_only, text.try_cast("double"))
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def strict_label(label: Column) -> Column:
    """Label as an integer. A bad label raises (ANSI cast) rather than turning into NULL."""
    return label.cast("int")


def with_default(df: DataFrame, name: str, value: str | None = SENTINEL) -> DataFrame:
    """Add a constant column when the input lacks it."""
    return df if name in df.columns else df.withColumn(name, F.lit(value).cast("string"))
