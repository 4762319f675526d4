"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns (email, ip, card, phone) give base spans, which stay. The field looks at the rest of a text. Its segments are
whole candidate spans: at most LONGEST tokens, scored by features of the span as a whole (digits, separators, checks, what
stands before and after), or single tokens outside any entity. Boundaries and kinds are chosen together by dynamic
programming over positions, bounded by the segment length. A segment without a digit, "@" or written-out "@" cannot be an
entity, so texts split into independent islands around these, and the programme runs within islands only.

The field is trained on islands of a bounded sample of documents. Their labels are the base spans; each labelled island is
also seen in altered forms that the patterns do not match (other separators, a written-out "@", a missing "+", digits in
front), so that shape and context have to carry the decision. An added span must beat its being outside by MARGIN.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm import common

KINDS = ("email", "ip", "card", "phone")
LONGEST = 15
#: Documents whose islands train the field, at most.
SAMPLE = 300
MARGIN = 2.0
#: Islands of a document that train the field, at most.
ISLANDS = 8

#: A written-out "@": bracketed, or the word before a domain with a dot or a written-out dot. Python, Java and RE2 read these alike.
WRITTEN = r"(?i:[(\[]at[)\]]|\bat [^\s.()\[\]]+ ?(?:\.[^\s.]|[(\[]dot[)\]]))"
TRIGGER = f"(?:[0-9@]|{WRITTEN})"
BRACKETED = re.compile(r"[(\[]at[)\]]", re.I)
MARK = re.compile(rf"{WRITTEN}|(?i:[(\[]dot[)\]])")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[(\[](?:at|dot)[)\]]|[0-9]+|[^\W\d_]+|\s+|.", re.S | re.I)


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(d) if i % 2 == 0 else int(doubled[int(d)]) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches. Each "@" is looked at once, so long words cost no more than short ones."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (found := EMAIL_DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def chains(text: str, runs: list[tuple[int, int]], between: str) -> Iterator[list[tuple[int, int]]]:
    """Maximal rows of digit runs with exactly one of the characters `between` from one to the next."""
    held: list[tuple[int, int]] = []
    for run in runs:
        if held and run[0] == held[-1][1] + 1 and text[held[-1][1]] in between:
            held.append(run)
        else:
            if held:
                yield held
            held = [run]
    if held:
        yield held


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, in order of start, then kind as listed."""
    runs = [m.span() for m in DIGITS.finditer(text)]
    found = [(a, b, "email") for a, b in emails(text)]
    for chain in chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in chain[k : k + 4]):
                found.append((chain[k][0], chain[k + 3][1], "ip"))
    for chain in chains(text, runs, " -"):
        if 12 <= sum(b - a for a, b in chain) <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            found.append((chain[0][0], chain[-1][1], "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def islands(text: str, taken: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int]]]:
    """Rows of neighbouring tokens that can hold a segment with a trigger, clear of the spans in `taken`.

    A token is a run of digits, letters or blanks, a bracketed "at" or "dot", or one other character. An island ends at a run of several blanks, at a
    line feed, beside a span, and where two words in a row have no trigger.
    """
    begins, ends = [], []  # of what the spans cover together
    for a, b, _ in taken:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    last = 0
    for m in re.finditer(TRIGGER, text):
        k = bisect_right(begins, m.start())
        if m.start() < last or k and m.start() < ends[k - 1]:
            continue
        low, high = max(last, ends[k - 1] if k else 0), begins[k] if k < len(begins) else len(text)
        start = m.start()
        words = 0
        while start > low and words < 2 and text[start - 1] != "\n":
            start -= 1
            words += text[start] == " " and start + 1 < m.start()
        end, quiet = m.end(), 0
        while end < high and text[end] != "\n":
            if text[end] in "([aA" and MARK.match(text, end):
                quiet = 0
            if quiet == 3:
                break
            if text[end] in "0123456789@":
                quiet = 0
            elif text[end] == " ":
                quiet += 1
            end += 1
        end = min(high, max(end, m.end()))
        last = end
        yield [(start + t.start(), start + t.end()) for t in TOKEN.finditer(text[start:end])]


FEATURES = (
    "bias", "at", "written_at", "written_part", "at_outer", "domain", "dots", "plus", "open_bracket", "spaces", "hyphens", "digits_1_8", "digits_9_11", "digits_12_15", "digits_13_19", "digits_20",
    "luhn", "octets", "four_runs", "letters", "only_digits", "one_separator", "mixed_separators", "begins_blank", "ends_blank", "begins_sign", "ends_sign", "touches_left", "touches_right", "fours", "threes", "long_run", "digits_left", "digits_right",
)
OF = {name: i for i, name in enumerate(FEATURES)}
WRITTEN_DOT = r"(?:\.| ?[(\[]dot[)\]] ?)"
WRITTEN_AT = re.compile(rf"[\w%+-]+(?:{WRITTEN_DOT}[\w%+-]+)* ?(?:[(\[]at[)\]]|\bat\b) ?[\w-]+(?:{WRITTEN_DOT}[\w-]+)+\Z", re.I)
MORE_LEFT = re.compile(r"(?:[(\[]dot[)\]] ?|[\w.%+-])\Z", re.I)
MORE_RIGHT = re.compile(r"[.-]?\w| ?[(\[]dot[)\]]", re.I)


def features(text: str, start: int, end: int) -> list[int]:
    """Features of the candidate span as a whole and of what stands beside it."""
    s = text[start:end]
    runs = DIGITS.findall(s)
    digits = "".join(runs)
    n, on = len(digits), ["bias"]
    letters = any(c.isalpha() for c in s)
    separators = {c for c in s if not c.isalnum()}
    left, right = text[start - 1 : start], text[end : end + 1]

    def mark(name: str, holds: bool) -> None:
        if holds:
            on.append(name)

    mark("at", s.count("@") == 1 and 0 < s.find("@") < len(s) - 1)
    written = "@" not in s and WRITTEN_AT.match(s) is not None
    mark("written_at", written)
    mark("written_part", written and bool(MORE_LEFT.search(text[max(0, start - 6) : start]) or MORE_RIGHT.match(text, end)))
    mark("at_outer", s.count("@") > 1 or s[:1] == "@" or s[-1:] == "@")
    mark("domain", "." in s.rpartition("@")[2] and "@" in s)
    mark("dots", "." in s and not letters)
    mark("plus", s[0] == "+")
    mark("open_bracket", "(" in s)
    mark("spaces", " " in s)
    mark("hyphens", "-" in s)
    for name, a, b in (("digits_1_8", 0, 8), ("digits_9_11", 9, 11), ("digits_12_15", 12, 15), ("digits_13_19", 13, 19), ("digits_20", 20, 1 << 30)):
        mark(name, a <= n <= b)
    mark("luhn", 13 <= n <= 19 and not letters and luhn(digits))
    mark("octets", len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs))
    mark("four_runs", len(runs) == 4)
    mark("letters", letters)
    mark("only_digits", n == len(s))
    mark("one_separator", len(separators) == 1)
    mark("mixed_separators", len(separators) > 1)
    mark("begins_blank", s[0].isspace())
    mark("ends_blank", s[-1].isspace())
    mark("begins_sign", not s[0].isalnum() and s[0] not in "+(")
    mark("ends_sign", not s[-1].isalnum() and not s[-1].isspace())
    mark("touches_left", left.isalnum())
    mark("touches_right", right.isalnum())
    mark("fours", len(runs) > 2 and all(len(r) == 4 for r in runs[:-1]))
    mark("threes", len(runs) > 2 and len(runs[-1]) == 4 and len(runs[-2]) == 3)
    mark("long_run", any(len(r) > 19 for r in runs))
    mark("digits_left", bool(re.search(r"[0-9][ .-]?\Z", text[max(0, start - 2) : start])))
    mark("digits_right", bool(re.match(r"[ .-]?[0-9]", text[end : end + 2])))
    return [OF[x] for x in on]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """Candidate entities of an island: (first token, token after the last, features), at most LONGEST tokens each."""
    out = []
    for i in range(len(tokens)):
        if text[tokens[i][0]].isspace():
            continue
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not text[b - 1].isspace() and (re.search(TRIGGER, text[a:b])):
                out.append((i, j, np.array(features(text, a, b))))
    return out


def expected(n: int, spans: list[tuple[int, int]], scores: list[float]) -> list[float]:
    """The probability of each candidate segment, by the forward and backward sums over all segmentations of an island."""
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    by_end = sorted(range(len(spans)), key=lambda k: spans[k][1])
    at = 0
    for j in range(1, n + 1):
        total = forward[j - 1]
        while at < len(by_end) and spans[by_end[at]][1] == j:
            total = add(total, forward[spans[by_end[at]][0]] + scores[by_end[at]])
            at += 1
        forward[j] = total
    at = len(spans) - 1  # candidates are in order of their first token
    for i in range(n - 1, -1, -1):
        total = backward[i + 1]
        while at >= 0 and spans[at][0] == i:
            total = add(total, backward[spans[at][1]] + scores[at])
            at -= 1
        backward[i] = total
    return [math.exp(forward[i] + s + backward[j] - forward[n]) for (i, j), s in zip(spans, scores, strict=True)]


def best(weights: np.ndarray, n: int, candidates: list[tuple[int, int, np.ndarray]], margin: float) -> list[tuple[int, int, int]]:
    """The best segmentation: (first token, token after the last, kind) of its entities, each worth more than `margin`."""
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j, _) in enumerate(candidates):
        ending[j].append(k)
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        for k in ending[j]:
            i, _, f = candidates[k]
            own = weights[:, f].sum(axis=1)
            kind = int(own.argmax())
            if score[i] + own[kind] - margin > score[j]:
                score[j], back[j] = score[i] + own[kind] - margin, (i, j, kind)
    out, at = [], n
    while at > 0:
        if back[at]:
            out.append(back[at])
            at = back[at][0]
        else:
            at -= 1
    return out[::-1]


def altered(text: str, a: int, b: int, kind: str) -> list[tuple[str, int, int]]:
    """An entity of the patterns in its place and in forms that they do not match: (text, start, end)."""
    before, s, after = text[max(0, a - 24) : a], text[a:b], text[b : b + 24]
    forms = [s]
    if kind == "email":
        forms += [s.replace("@", " (at) "), s.replace("@", "[at]"), s.replace("@", " @ "), s.replace("@", " [at] ").replace(".", " [dot] ")]
    elif kind == "card":
        d = "".join(c for c in s if c.isdigit())
        forms += [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in (".", "/", "  ")]
    elif kind == "phone":
        forms += [s.lstrip("+"), s[s.find("(") :] if "(" in s else s[2:].lstrip(), s.replace(" ", "/")]
    else:
        forms += [s.replace(".", " . "), s.replace(".", "[.]")]
    out = [(before + f + after, len(before), len(before) + len(f)) for f in forms if f]
    return out + [(before + "7 " + s + after, len(before) + 2, len(before) + 2 + len(s))] * (kind == "card")


def examples(text: str) -> Iterator[tuple[int, list, set]]:
    """(tokens, candidates, gold) of training islands of a text."""
    spans = base_spans(text)[:ISLANDS]
    for a, b, kind in spans:
        for form, start, end in altered(text, a, b, kind):
            for tokens in islands(form, []):
                starts, ends = {t[0]: i for i, t in enumerate(tokens)}, {t[1]: i + 1 for i, t in enumerate(tokens)}
                if start in starts and end in ends and ends[end] - starts[start] <= LONGEST:
                    yield len(tokens), segments(form, tokens), {(starts[start], ends[end], KINDS.index(kind))}
    for k, tokens in enumerate(islands(text, spans)):
        if k >= ISLANDS:
            break
        if not BRACKETED.search(text, tokens[0][0], tokens[-1][1]):  # such an address has no label and is no evidence against itself
            yield len(tokens), segments(text, tokens), set()


def train(docs: DataFrame, sample: int = SAMPLE, rounds: int = 40, ridge: float = 0.5) -> np.ndarray:
    """Weights (kinds x features) from a sample of at most `sample` texts with a trigger, the first by hash.

    The sample only trains the field; every document is decoded. Without any such text all weights are 0 but those that
    keep segments outside.
    """
    # hashes first, so that no task sends whole texts; equal texts have equal hashes and count once
    h = F.xxhash64("text").alias("h")
    first = [r["h"] for r in docs.where(F.col("text").rlike(TRIGGER)).select(h).distinct().orderBy("h").limit(sample).collect()]
    around = F.regexp_extract_all("text", F.lit(f"(?s).{{0,60}}{TRIGGER}.{{0,60}}"), F.lit(0))
    trimmed = docs.where(F.xxhash64("text").isin(first)).select(h, F.array_join(F.slice(around, 1, ISLANDS), "\n").alias("text"))
    found = sorted(trimmed.groupBy("h").agg(F.min("text").alias("text")).collect()) if first else []
    data = [e for r in found for e in examples(r["text"]) if e[1]]
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, OF["bias"]] = -4.0
    rows = sum(len(c) for _, c, _ in data)
    x, gold = np.zeros((rows, len(FEATURES)), np.float32), np.zeros((rows, len(KINDS)), np.float32)
    k = 0
    for _, candidates, entities in data:
        for i, j, on in candidates:
            x[k, on] = 1
            for a, b, kind in entities:
                gold[k, kind] += (a, b) == (i, j)
            k += 1
    squares = np.full_like(weights, 1e-8)
    for _ in range(rounds if rows else 0):
        scores = x @ weights.T
        top = scores.max(axis=1, keepdims=True)
        joint = top[:, 0] + np.log(np.exp(scores - top).sum(axis=1))
        share, k = np.zeros(rows), 0
        for n, candidates, _ in data:
            end = k + len(candidates)
            share[k:end] = expected(n, [c[:2] for c in candidates], joint[k:end].tolist())
            k = end
        total = (gold - share[:, None] * np.exp(scores - joint[:, None])).T @ x - ridge * weights
        squares += total * total
        weights = weights + total / np.sqrt(squares)
    return weights


def found_spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and added spans) of a text, in order."""
    base = base_spans(text)
    added = []
    for tokens in islands(text, base):
        for i, j, kind in best(weights, len(tokens), segments(text, tokens), margin):
            added.append((tokens[i][0], tokens[j - 1][1], KINDS[kind]))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """A row for each row of `docs`: doc_id, base spans by kind, their digest, and all spans (code points, end exclusive).

    A null or empty text has no span. Other columns are not read.
    """
    weights = train(docs) if weights is None else weights

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column("text").fill_null("")
            rows = [(0, 0, 0, 0, nothing, "")] * len(texts)
            hit = pc.match_substring_regex(texts, TRIGGER)
            for k, text in zip(np.flatnonzero(hit.to_numpy(zero_copy_only=False)).tolist(), texts.filter(hit).to_pylist(), strict=True):
                base, spans = found_spans(text, weights)
                counts = [sum(s[2] == kind for s in base) for kind in KINDS]
                rows[k] = (*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(common.tidied(find), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def masked(text: str, weights: np.ndarray) -> str:
    """The text with each span replaced by its kind; of overlapping spans, one mask covers them all."""
    out, at = [], 0
    for a, b, kind in found_spans(text, weights)[1]:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The rows of `docs` with personal data masked in `text` and, where it is there, `n_chars` counted anew."""
    weights = train(docs) if weights is None else weights

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            hit = pc.match_substring_regex(texts, TRIGGER).fill_null(False)
            if pc.any(hit).as_py():
                changed = pa.array([masked(t, weights) for t in texts.filter(hit).to_pylist()], texts.type)
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, hit, changed))
            yield batch

    out = docs.mapInArrow(common.tidied(hide), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
