"""Date parsing and calendar flags, all in UTC whatever the session time zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS

# Day names, in the order counted from 1970-01-01 (a Thursday).
DAY_NAMES = ["Thursday", "Friday", "Saturday", "Sunday", "Monday", "Tuesday", "Wednesday"]

SHAPE = r"^(\d{1,2}| \d) [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} ([+-]([01]\d|2[0-3]):?[0-5]\d|Z)\z"


def strip_date(date: Column) -> Column:
    """Drop a leading "Tue, " and a trailing " (PDT)"."""
    without_day = F.regexp_replace(date, F.lit(rf"^[A-Za-z]{{3}},[{WS}]+"), F.lit(""))
    return F.regexp_replace(without_day, F.lit(rf"(?d)[{WS}]+\([^)]+\)$"), F.lit(""))


def parse_date(stripped: Column) -> Column:
    """Instant of text like "05 Aug 2008 16:31:02 -0700"; NULL for anything else.

    The shape is checked first because Spark's parser is laxer on day digits. A second of 60 or 61 rolls
    over into the next minute. Offsets go up to 23:59 and are subtracted here, as Spark's parser ends at 18:00.
    Instants outside the 64-bit nanosecond range are NULL.
    """
    text = F.regexp_replace(stripped, F.lit(rf"[{WS}]+"), F.lit(" "))
    leap = F.regexp_extract(text, r":6([01]) ", 1)
    whole = F.regexp_replace(text, F.lit(r":6[01] "), F.lit(":59 "))
    shaped = F.ltrim(F.when(text.rlike(SHAPE), whole))
    in_utc = F.regexp_replace(shaped, F.lit(r" (Z|[+-][\d:]+)$"), F.lit(" +0000"))
    instant = F.try_to_timestamp(in_utc, F.lit("d MMM yyyy H:m:s xx"))

    def offset(part: int) -> Column:
        return F.coalesce(F.regexp_extract(shaped, r" [+-](\d{2}):?(\d{2})$", part).try_cast("long"), F.lit(0))

    ahead = (offset(1) * 3600 + offset(2) * 60) * F.when(shaped.rlike(r" -[\d:]+$"), -1).otherwise(1)
    extra = F.when(leap == "0", 1).when(leap == "1", 2).otherwise(0)
    seconds = F.unix_seconds(instant) + extra - ahead
    # 1677-09-21 00:12:44 to 2262-04-11 23:47:16
    return F.when(seconds.between(-9223372036, 9223372036), F.timestamp_seconds(seconds))


def day_of_week(instant: Column) -> Column:
    names = F.array(*[F.lit(name) for name in DAY_NAMES])
    days = F.floor(F.unix_seconds(instant) / F.lit(86400)).cast("long")
    return F.get(names, F.pmod(days, F.lit(7)).cast("int"))


def is_weekend(instant: Column) -> Column:
    days = F.floor(F.unix_seconds(instant) / F.lit(86400)).cast("long")
    return F.coalesce(F.pmod(days, F.lit(7)).isin(2, 3), F.lit(False)).cast("int")


def is_night(instant: Column) -> Column:
    """1 before five in the morning, UTC."""
    second = F.pmod(F.unix_seconds(instant), F.lit(86400))
    return F.coalesce(second < 5 * 3600, F.lit(False)).cast("int")
