"""Tokens and word n-grams as array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import by_script
from .stopwords import ENGLISH


def tokens(text: Column, stop_words: Sequence[str] | None = ENGLISH) -> Column:
    """Lower-case runs of two or more word characters, stop words removed; empty for missing text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    found = by_script(lowered, lambda kind: F.regexp_extract_all(lowered, F.lit(f"{kind.word}{{2,}}"), F.lit(0)))
    if not stop_words:
        return found
    listed = list(stop_words)
    return F.filter(found, lambda token: ~token.isin(listed))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of `low` to `high` words, joined by a space. `words` should be a stored column.

    An n-gram with a NULL word is NULL.
    """
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    return F.concat(*[_of_length(words, n) for n in range(low, high + 1)])


def _of_length(words: Column, n: int) -> Column:
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
        F.array().cast("array<int>")
    )

    def joined(start: Column) -> Column:
        parts = [F.get(words, start)]
        for offset in range(1, n):
            parts += [F.lit(" "), F.get(words, start + offset)]
        return F.concat(*parts)

    return F.transform(starts, joined)
