"""Text statistics and the text cleaning chain."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import Classes, by_script, count_chars, strip
from .missing import blank_sentinel, from_sentinel

# Repairs of text decoded in the wrong charset, applied one after another in this order.
# The order decides the result: the short keys come before some longer ones that start the same way.
MOJIBAKE = [
    ("â€™", "'"),
    ("â€œ", '"'),
    ("â€", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("Ã©", "é"),
    ("Ã¨", "è"),
    ("Ãª", "ê"),
    ("Ã«", "ë"),
    ("Ã", "à"),
    ("Ã¢", "â"),
    ("Ã§", "ç"),
    ("Ã®", "î"),
    ("Ã¯", "ï"),
    ("Ã´", "ô"),
    ("Ã»", "û"),
    ("Ã¹", "ù"),
    ("Ã¶", "ö"),
    ("Ã¼", "ü"),
    ("Â©", "©"),
    ("Â®", "®"),
    ("Â£", "£"),
    ("Â", ""),
]
# Fixed value: what a run of four or more symbols becomes.
NOISE = "[SYMBOL_NOISE]"

# Text made only of these characters is left alone by NFKC: none of them decomposes, and none combines with a
# neighbour. ASCII, Latin letters up to U+0131, Cyrillic letters, dashes and quotes without a compatibility form,
# kana and common ideographs. A unit test compares the class with Python's tables.
NFKC_INERT_BEYOND_ASCII = (
    r"\xc0-\u0131\u0400-\u045f\u2010\u2012-\u2016\u2018-\u2023"
    r"\u3001-\u3029\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5"
)


def needs_python(text: Column) -> Column:
    """Whether a text may hold an HTML entity or a character that NFKC changes.

    The cheap tests come first: most text is ASCII without "&", and in the rest most characters are.
    """
    foreign = text.rlike(rf"[\x80-\x{{10ffff}}&&[^{NFKC_INERT_BEYOND_ASCII}]]")
    entity = text.rlike("&[#A-Za-z]")
    return ((F.octet_length(text) > F.length(text)) & foreign) | (F.contains(text, F.lit("&")) & entity)


def capital_share(text: Column) -> Column:
    """Upper-case letters per character; 0 for empty text."""
    capitals = by_script(text, lambda kind: count_chars(text, kind.upper))
    return F.coalesce(capitals / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    bare = strip(text)
    words = by_script(text, lambda kind: F.size(F.split(bare, f"{kind.blank}+")))
    return F.when(bare == "", F.lit(0)).otherwise(words)


def joined(subject: Column, body: Column) -> Column:
    """Subject, a space and body, stripped. Missing parts count as empty."""
    return strip(F.concat(blank_sentinel(subject), F.lit(" "), blank_sentinel(body)))


def symbol_count(text: Column) -> Column:
    return by_script(text, lambda kind: count_chars(text, kind.symbol))


def symbol_ratio(symbols: Column, total: Column) -> Column:
    return F.coalesce(symbols / F.nullif(total, F.lit(0)), F.lit(0.0))


def repeated_symbol_runs(text: Column) -> Column:
    """Runs in which one symbol stands at least three times in a row."""
    return by_script(text, lambda kind: F.regexp_count(text, F.lit(rf"({kind.symbol})\1{{2,}}")))


def python_unescape() -> Callable[[Column], Column]:
    """HTML5 entities, escaped characters and NFKC for the rows that need Python's tables; NULL stays NULL.

    One function for the three steps, because NFKC can yield characters that the step before it looks for.
    The worker function is local so that it travels to executors by value.
    """

    def run(texts: pd.Series) -> pd.Series:
        import html
        import re
        import unicodedata

        blank = re.compile(r"\\[nrt]|[\n\r\t]")
        quote = re.compile(r"""\\(["'])""")

        def one(text):
            text = quote.sub(r"\1", blank.sub(" ", html.unescape(text)))
            return unicodedata.normalize("NFKC", text)

        return texts.map(one, na_action="ignore")

    # pandas_udf reads the hints, which postponed annotations would leave as text
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


# Escaped characters as literal text, and what they become.
ESCAPED = [("\\n", " "), ("\\r", " "), ("\\t", " "), ('\\"', '"'), ("\\'", "'")]


def _replace_all(column: str, pairs: list[tuple[str, str]]) -> Column:
    """The replacements one after another, as one SQL expression."""

    def literal(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    sql = f"`{column}`"
    for bad, good in pairs:
        sql = f"replace({sql}, {literal(bad)}, {literal(good)})"
    return F.expr(sql)


def clean_text(df: DataFrame, columns: dict[str, str], mojibake: str = "as_listed") -> DataFrame:
    """Add a cleaned version of each text column: `columns` maps input name to output name.

    `mojibake="as_listed"` applies the repairs in their listed order after NFKC, where some can never match;
    "longest_first" applies them longest key first and before NFKC, so that every repair works.
    NULL, "" and "NaN" give NULL, as does text of which nothing remains.
    """
    if mojibake not in ("as_listed", "longest_first"):
        raise ValueError(f"unknown mojibake mode {mojibake!r}")
    kept = df.columns
    unescape = python_unescape()
    raw = {out: f"__raw_{out}" for out in columns.values()}
    step = {out: f"__step_{out}" for out in columns.values()}
    outs = list(raw)

    # each step is a projection of its own, so that a value used twice is computed once
    df = df.withColumns({raw[o]: F.nullif(from_sentinel(F.col(c)), F.lit("")) for c, o in columns.items()})
    if mojibake == "longest_first":
        pairs = sorted(MOJIBAKE, key=lambda pair: -len(pair[0]))
        df = df.withColumns({raw[o]: _repaired(raw[o], pairs) for o in outs})
    # A row without entities whose characters NFKC leaves alone stays in the JVM: its escapes are replaced there,
    # and its real line breaks and tabs go with the whitespace collapse at the end.
    df = df.withColumns({step[o]: F.when(needs_python(F.col(raw[o])), F.col(raw[o])) for o in outs})
    df = df.withColumns(
        {step[o]: F.coalesce(unescape(F.col(step[o])), _replace_all(raw[o], ESCAPED)) for o in outs}
    )
    if mojibake == "as_listed":
        df = df.withColumns({step[o]: _repaired(step[o], MOJIBAKE) for o in outs})
    df = df.withColumns({step[o]: _finished(F.col(step[o])) for o in outs})
    return df.select(*[c for c in kept if c not in raw], *[F.col(step[o]).alias(o) for o in outs])


def _repaired(column: str, pairs: list[tuple[str, str]]) -> Column:
    text = F.col(column)
    return F.when(text.rlike("[âÃÂ]"), _replace_all(column, pairs)).otherwise(text)


def _finished(text: Column) -> Column:
    """Symbol noise, whitespace, case; the marker keeps its capitals. Empty text is missing."""

    def spaced(kind: Classes) -> Column:
        marked = F.regexp_replace(text, F.lit(f"{kind.symbol}{{4,}}"), F.lit(f" {NOISE} "))
        return F.regexp_replace(marked, F.lit(f"{kind.blank}+"), F.lit(" "))

    cleaned = F.lower(F.btrim(by_script(text, spaced)))
    return F.nullif(F.replace(cleaned, F.lit(NOISE.lower()), F.lit(NOISE)), F.lit(""))
