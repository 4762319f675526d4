"""Sender parsing. Every function takes and returns a Column; NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS, strip


def clean_sender(sender: Column) -> Column:
    """Stripped sender; NULL when blank, "NaN", or ending in an empty address such as "Bob < >"."""
    text = strip(sender)
    empty_address = text.rlike(rf"<[{WS}]*>[{WS}]*\z")
    return F.when((sender != "NaN") & (text != "") & ~empty_address, text)


def sender_email(cleaned: Column) -> Column:
    """The first non-empty <...> part, or the whole sender when there is none."""
    return strip(F.when(cleaned.rlike("<[^<>]+>"), F.regexp_extract(cleaned, "<([^<>]+)>", 1)).otherwise(cleaned))


def sender_domain(email: Column) -> Column:
    """What stands between the first and the second "@"; NULL without "@", empty for "x@"."""
    return F.get(F.split(email, "@"), F.lit(1))


def sender_tld(domain: Column) -> Column:
    """What follows the last dot of the domain (all of it when there is no dot)."""
    return F.element_at(F.split(domain, r"\."), -1)
