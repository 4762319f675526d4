"""Edge rows with expected values written by hand, and character classes against Python's own."""

import html
import re
import unicodedata
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from mailsift.functions import chars, dates, missing, ngrams, sender, text
from mailsift.plans import clean


def one_column(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_sender(spark):
    given = ["", "NaN", "   ", "Bob <  >", "Bob <>", "Bob < > \n", " Bob <b@x.com> ", None]
    assert one_column(spark, given, sender.clean_sender) == [None] * 6 + ["Bob <b@x.com>", None]


def test_sender_email(spark):
    given = ["Bob <b@x.com>", "b@x.com", "<> <c@y.org>", "Bob < b@x.com >", "A <a@a> <b@b>", None]
    assert one_column(spark, given, sender.sender_email) == ["b@x.com", "b@x.com", "c@y.org", "b@x.com", "a@a", None]


def test_sender_domain_and_tld(spark):
    assert one_column(spark, ["a@b@c", "nope", "x@", None], sender.sender_domain) == ["b", None, "", None]
    assert one_column(spark, ["mail.x.co.uk", "host", "", "com.", None], sender.sender_tld) == ["uk", "host", "", "", None]


def test_capital_share_and_words(spark):
    assert one_column(spark, ["", "AbC", "ÉÈ", "abc"], text.capital_share) == [0.0, pytest.approx(2 / 3), 1.0, 0.0]
    assert one_column(spark, ["", " a  b c\x1cd ", "　"], text.word_count) == [0, 4, 0]


def test_symbols(spark):
    given = ["hi!!! $$$$ ..", "a_b ½ ²", "", "é", "😀😀😀"]
    assert one_column(spark, given, text.symbol_count) == [9, 0, 0, 1, 3]
    assert one_column(spark, given, text.repeated_symbol_runs) == [2, 0, 0, 0, 1]


def test_character_classes_agree_with_python(spark):
    # below U+0870 the tables of Java and Python hold the same characters
    points = [chr(c) for c in range(1, 0x0870)] + [chr(c) for c in range(0x2000, 0x2070)] + [" ", "　"]
    assert one_column(spark, points, lambda c: text.symbol_count(c)) == [len(re.findall(r"[^\w\s]", c)) for c in points]
    padded = [f"{c}x{c}" for c in points]
    assert one_column(spark, padded, chars.strip) == [p.strip() for p in padded]
    words = [f"a{c}b" for c in points]
    assert one_column(spark, words, text.word_count) == [len(w.split()) for w in words]
    assert one_column(spark, points, text.capital_share) == [float(c.isupper()) for c in points]


def test_inert_characters_are_left_alone_by_nfkc(spark):
    inert = re.compile(f"[\x00-\x7f{text.NFKC_INERT_BEYOND_ASCII}]")
    letters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and inert.match(chr(c))]
    whole = "".join(letters) + "".join(reversed(letters)) + "".join(a + "a" for a in letters)
    assert unicodedata.normalize("NFKC", whole) == whole
    assert all(unicodedata.combining(c) == 0 for c in letters)
    asked = letters[1:] + ["™", "ﬁ", "é", " ", "각", "…", "が"]
    needed = one_column(spark, asked, text.needs_python)
    assert needed == [False] * (len(letters) - 1) + [True] * 7


CLEANED = {
    "win!!!!now": "win [SYMBOL_NOISE] now",
    "A &amp; B\n": "a & b",
    "â€™": '"tm',
    "â€œHiâ€": '"hi"',
    "a \u00e2\u20ac\u201c b": 'a "\u201c b',
    "Ã© Ã§": "é à§",
    "Â£5 Â": "£5",
    "": None,
    "NaN": None,
    "one two": "one two",
    "a\\nb\\tc \\\"d\\'": "a b c \"d'",
    "＼n": "\\n",
    "&notit; &#x41; &lt;b&gt;": "¬it; a <b>",
    "  \r\n ": None,
    "say [symbol_noise]": "say [SYMBOL_NOISE]",
    "&&&& &": "[SYMBOL_NOISE] &",
    "ÀÉ ΑΣ": "àé ας",
    "!!! ....": "!!! [SYMBOL_NOISE]",
}


def test_clean_text(spark):
    df = spark.createDataFrame(list(enumerate(CLEANED)), "i int, x string")
    rows = text.clean_text(df, {"x": "y"}).orderBy("i").collect()
    assert {r["x"]: r["y"] for r in rows} == CLEANED


def test_native_and_python_steps_agree(spark):
    """A row that stays in the JVM comes out as if Python had taken it."""
    given = [r"a\nb", r"\\n", r"\\\"q\\'", "tab\there", r"\\\\t", "é\\r", 'x\\"y', "a\\'b\\n"]
    df = spark.createDataFrame([(i, t, t + " ™") for i, t in enumerate(given)], "i int, x string, z string")
    rows = text.clean_text(df, {"x": "native", "z": "python"}).orderBy("i").collect()
    assert [r["python"] for r in rows] == [r["native"] + " tm" for r in rows]


def test_unescape_follows_python(spark):
    given = ["&amp;amp;", "&copy", "&copyx", "&#128;", "&#xD800;", "&nosuch;", "&;", "& x"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string")
    rows = text.clean_text(df, {"x": "y"}).orderBy("i").collect()
    assert [r["y"] for r in rows] == [unicodedata.normalize("NFKC", html.unescape(g)).lower() for g in given]


def test_mojibake_longest_first(spark):
    df = spark.createDataFrame([("donâ€™t â€“ Ã©tÃ¨",)], "x string")
    assert text.clean_text(df, {"x": "y"}, "longest_first").first()["y"] == "don't - étè"
    with pytest.raises(ValueError):
        text.clean_text(df, {"x": "y"}, "other")


DATES = {
    "05 Aug 2008 16:31:02 -0700 (PDT)": datetime(2008, 8, 5, 23, 31, 2),
    "Tue, 05 Aug 2008 16:31:02 -0700": datetime(2008, 8, 5, 23, 31, 2),
    "Sat, 06 Jan 2024 04:59:59 +0000": datetime(2024, 1, 6, 4, 59, 59),
    "5  aug\t2008 6:1:2 +00:00": datetime(2008, 8, 5, 6, 1, 2),
    "05 Aug 2008 16:31:02 Z": datetime(2008, 8, 5, 16, 31, 2),
    "06 Aug 2008 10:00:00 +1900": datetime(2008, 8, 5, 15, 0, 0),
    "06 Aug 2008 10:00:00 -23:59": datetime(2008, 8, 7, 9, 59, 0),
    "06 Aug 2008 10:00:00 +2400": None,
    "06 Aug 2008 10:00:00 +0060": None,
    "05 Aug 2008 16:59:60 +0000": datetime(2008, 8, 5, 17, 0, 0),
    "05 Aug 2008 16:31:02 GMT": None,
    "31 Feb 2008 10:00:00 +0000": None,
    "05 Aug 2008 24:00:00 +0000": None,
    "05 Aug 08 10:00:00 +0000": None,
    "05 August 2008 10:00:00 +0000": None,
    "005 Aug 2008 10:00:00 +0000": None,
    "05 Aug 2008 10:00:00 -07": None,
    "05 Aug 2008 10:00:00+0000": None,
    "05 Aug 2008 10:00:00 +0000 ": None,
    "05 Aug 1600 10:00:00 +0000": None,
    "bad": None,
    "": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(list(enumerate(DATES)), "i int, date string")
        rows = clean.with_date_features(df).select("*", F.unix_seconds("datetime").alias("s")).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for row, (given, instant) in zip(rows, DATES.items()):
        want = None if instant is None else int(instant.replace(tzinfo=timezone.utc).timestamp())
        assert row["s"] == want, given
        assert row["day_of_week"] == (instant and instant.strftime("%A")), given
        assert row["is_weekend"] == int(instant is not None and instant.weekday() >= 5), given
        assert row["is_night"] == int(instant is not None and instant.hour < 5), given


def test_missing_values(spark):
    assert one_column(spark, ["NaN", "", "a NaN", None], missing.blank_sentinel) == ["", "", "a NaN", ""]
    assert one_column(spark, ["NaN", "", "x", None], missing.to_sentinel) == ["NaN", "NaN", "x", "NaN"]
    given = ["1.5", " 2 ", "1e3", "x", "", "1d", "2F", "NaN", None, "-3", "0x1p3"]
    assert one_column(spark, given, missing.number_or_zero) == [1.5, 2.0, 1000.0, 0, 0, 0, 0, 0, 0, -3.0, 0]


def test_bad_label_raises(spark):
    with pytest.raises(Exception):
        one_column(spark, ["spam"], missing.strict_label)


def test_joined_and_defaults(spark):
    df = spark.createDataFrame([("NaN", " b "), ("a", None)], "s string, b string")
    assert [r[0] for r in df.select(text.joined(F.col("s"), F.col("b"))).collect()] == ["b", "a"]
    assert missing.with_default(df, "urls").first()["urls"] == "NaN"
    assert missing.with_default(df, "s").first()["s"] == "NaN"


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("The Cat's x_1 sat; été ½½",), ("a",), (None,)], "x string")
    df = df.select(ngrams.tokens(F.col("x"), ["the"]).alias("w"))
    assert [r["w"] for r in df.collect()] == [["cat", "x_1", "sat", "été", "½½"], [], []]
    grams = [r["g"] for r in df.select(ngrams.ngrams(F.col("w"), 1, 3).alias("g")).collect()]
    words = ["cat", "x_1", "sat", "été", "½½"]
    want = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    assert grams == [want, [], []]
    with pytest.raises(ValueError):
        ngrams.ngrams(F.col("w"), 2, 1)
