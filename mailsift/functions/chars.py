"""Character classes that mean the same in Java regular expressions as Python's Unicode-aware \\w and \\s.

Java's own \\w and \\s are ASCII-only, so patterns here spell the classes out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


class Classes(NamedTuple):
    """Patterns for one character of each kind."""

    symbol: str
    blank: str
    upper: str
    word: str


FULL = Classes(f"[^{WORD}{WS}]", f"[{WS}]", r"\p{IsUppercase}", f"[{WORD}]")


def _listed(member: Callable[[str], object]) -> str:
    return "[" + "".join(f"\\x{code:02x}" for code in range(256) if member(chr(code))) + "]"


# The same kinds among the characters up to U+00FF, one by one: Java looks these up in a bit table, two to three
# times as fast as the Unicode properties.
LATIN1 = Classes(
    _listed(lambda c: re.match(r"[^\w\s]", c)), _listed(str.isspace), _listed(str.isupper), _listed(re.compile(r"\w").match)
)


def by_script(text: Column, build: Callable[[Classes], Column]) -> Column:
    """`build` on the short classes for text without characters beyond U+00FF, and on the full ones for the rest."""
    return F.when(text.rlike(r"[^\x00-\xff]"), build(FULL)).otherwise(build(LATIN1))


# the characters of the class WS
BLANKS = "".join(
    [chr(c) for c in range(0x09, 0x0E)]
    + [chr(c) for c in range(0x1C, 0x21)]
    + ["\x85", "\xa0", "\u1680"]
    + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace. A trim looks at the ends only, unlike a pattern."""
    return F.btrim(text, F.lit(BLANKS))


def count_chars(text: Column, char_class: str) -> Column:
    """Number of characters of a one-character class, without building an array of the matches."""
    return F.length(text) - F.length(F.regexp_replace(text, F.lit(char_class), F.lit("")))
