"""Quality of documents from a linear-chain conditional random field over their lines.

Every line is good or bad. Its features are its own measures and those of the lines before and after it, each cut into bins,
and the mean weight of its hashed words; neighbouring labels are tied by transition weights. The field is fitted on documents
marked good or bad as a whole, whose lines all count as marked so. A document's score is the mean of its lines' marginals of
being good, as forward-backward gives them, weighted by the length of the lines.

Products of the transition matrices along all lines are built by doubling, segment by segment, so that one document of a
million lines costs twenty steps over arrays and not a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm import common

#: Marked documents that the field is fitted on, at most; they are the first by a hash of their ids.
SAMPLE = 4000
#: A marked document with more lines is not fitted on, which bounds what the sample holds.
LINES = 2000
#: Bins of each measure, and one for a neighbour that is not there.
BINS = 8
MEASURES = 13
PER_LINE = 3 * MEASURES
SHAPES = PER_LINE * (BINS + 1)
#: Buckets of hashed words.
BUCKETS = 1 << 12
WIDTH = SHAPES + BUCKETS
#: Strength of the penalty on squared weights.
PENALTY = 0.3

UPPER, LETTER, DIGIT, SYMBOL, MARK = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3:0xF5] = True
DIGIT[48:58] = True
SYMBOL[list(b"#*$%&|<>{}[]=_~^\\@/+")] = True
MARK[list(b".,;:!?'\"()-")] = True
#: Lower ends of the bins 1 to 7 of a share.
SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8])


@dataclass
class Lines:
    """Lines of several texts in a row."""

    per_doc: np.ndarray
    length: np.ndarray
    cells: np.ndarray  # feature numbers, PER_LINE for each line
    words: np.ndarray  # bucket of each word
    word_line: np.ndarray
    n_words: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The place of each text's first line."""
        return np.cumsum(self.per_doc) - self.per_doc


def lines_of(texts: pa.ChunkedArray | pa.Array) -> Lines:
    """The lines of each text, cut at line feeds. An empty or null text is one empty line."""
    data, offsets = common.text_bytes(texts)
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])
    start = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    per_doc = np.bincount(doc, minlength=n)
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    end = np.where(last, offsets[doc + 1], np.append(start[1:], 0) - 1) if n else start
    length = end - start

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(marks, dtype=np.int64))
        return total[end] - total[start]

    upper = UPPER[data]
    lead = data[:-1] == 0xC3
    upper[1:] |= lead & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    words = common.words(data, offsets)
    hashes = words.hashed(common.LOWER[data])
    line = np.searchsorted(start, words.start, "right") - 1  # of lines that begin at one place the last is not empty
    n_words = np.bincount(line, minlength=len(start))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))[: len(line)]
    twins = np.lexsort((hashes, line))
    new = np.append(True, (hashes[twins][1:] != hashes[twins][:-1]) | (line[twins][1:] != line[twins][:-1]))[: len(line)]
    whole = common.Runs(start, end, doc, per_doc).hashed(data)
    order = np.lexsort((whole, doc))
    again = np.zeros(len(start), bool)
    repeated = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:]] = repeated
    again &= n_words > 0

    def share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.searchsorted(SHARES, part / np.maximum(of, 1), "right")

    def magnitude(x: np.ndarray, step: float = 1.0) -> np.ndarray:
        return np.minimum(BINS - 1, np.log2(1 + x) / step).astype(np.int64)

    chars = np.maximum(length, 1)
    kind = np.zeros(257, np.int64)
    for k, marks in enumerate((LETTER, DIGIT, SYMBOL, MARK), 1):
        kind[:256][marks] = k
    kind[65:91] = 5
    padded = np.append(data, 0)
    opening = np.where(length > 0, kind[padded[start]], 6)
    closing = np.where(length > 0, kind[padded[np.maximum(end - 1, 0)]], 6)
    measures = np.stack([
        magnitude(length, 1.5), magnitude(n_words, 1.25), magnitude((length - count(common.SPACE[data])) / np.maximum(n_words, 1), 0.6),
        share(count(upper), count(LETTER[data])), share(count(DIGIT[data]), chars), share(count(SYMBOL[data]), chars), share(count(MARK[data]), chars),
        share(np.bincount(line[same], minlength=len(start)), n_words), share(n_words - np.bincount(line[twins][new], minlength=len(start)), n_words),
        share(count(common.SPACE[data]), chars), again.astype(np.int64), opening, closing,
    ])
    # the measures of a line, of the one before and of the one after; the last bin stands for no such line
    absent = np.full((MEASURES, 1), BINS)
    begins = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    before = np.where(begins, BINS, np.hstack([absent, measures[:, :-1]])) if n else measures
    after = np.where(last, BINS, np.hstack([measures[:, 1:], absent])) if n else measures
    binned = np.concatenate([measures, before, after])
    cells = (binned + (np.arange(PER_LINE) * (BINS + 1))[:, None]).T
    return Lines(per_doc, length, np.ascontiguousarray(cells), (hashes % np.uint64(BUCKETS)).astype(np.int64), line, n_words)


def own_scores(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """The weight that each line's features give to good, against bad."""
    of_words = np.bincount(lines.word_line, weights[SHAPES + lines.words], minlength=len(lines.length))
    return weights[lines.cells].sum(axis=1) + of_words / np.maximum(lines.n_words, 1)


def products(matrices: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each line, the product of the matrices (rows of 4) from the first line of its text on, up to a factor.

    `place` is the line's place in its text. Doubling: after k steps a product spans 2^k lines.
    """
    out, step, longest = matrices.copy(), 1, int(place.max(initial=0))
    while step <= longest:
        at = np.flatnonzero(place >= step)
        a, b, c, d = out[at - step].T
        e, f, g, h = out[at].T
        new = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h], axis=1)
        out[at] = new / new.max(axis=1, keepdims=True)
        step *= 2
    return out


def marginals(lines: Lines, scores: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, P(label, label) of each line and the one before, messages' logarithmic factor left out).

    `ties` are the weights of (bad, bad), (bad, good), (good, bad), (good, good).
    """
    n = len(scores)
    first, place = lines.first, np.arange(n) - np.repeat(lines.first, lines.per_doc)
    bad, good = np.exp(np.minimum(0, -scores)), np.exp(np.minimum(0, scores))  # up to a factor for each line
    tie = np.exp(ties - ties.max())
    step = np.stack([tie[0] * bad, tie[1] * good, tie[2] * bad, tie[3] * good], axis=1)
    step[first] = np.stack([bad[first], good[first], bad[first], good[first]], axis=1)  # no label before
    forward = products(step, place)[:, :2]
    forward /= forward.sum(axis=1, keepdims=True)
    # the same from the end: matrices of what follows, transposed
    left = np.repeat(lines.per_doc, lines.per_doc) - 1 - place
    back = np.ones((n, 4))
    inner = np.flatnonzero(left > 0)
    back[inner] = np.stack([tie[0] * bad[inner + 1], tie[2] * bad[inner + 1], tie[1] * good[inner + 1], tie[3] * good[inner + 1]], axis=1)
    backward = products(back[::-1], left[::-1])[::-1]
    # a product ends with the line's own matrix; its row sums over the last label are the message
    message = np.stack([backward[:, 0] + backward[:, 2], backward[:, 1] + backward[:, 3]], axis=1)
    both = forward * message
    node = both / both.sum(axis=1, keepdims=True)
    at = np.flatnonzero(place > 0)
    pair = np.repeat(forward[at - 1], 2, axis=1) * tie * np.stack([bad[at], good[at]] * 2, axis=1) * np.hstack([message[at]] * 2)
    return node[:, 1], pair / pair.sum(axis=1, keepdims=True), at


def fitted(lines: Lines, marks: np.ndarray, penalty: float = PENALTY, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties of the largest penalised likelihood, where all lines of a text bear its mark (0 or 1)."""
    of_line = np.repeat(marks, lines.per_doc).astype(np.float64)
    width = SHAPES + BUCKETS

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        scores, ties = own_scores(lines, x[:width]), x[width:]
        good, pair, at = marginals(lines, scores, ties)
        gap = good - of_line
        gradient = np.zeros_like(x)
        gradient[:SHAPES] = np.bincount(lines.cells.ravel(), np.repeat(gap, PER_LINE), minlength=SHAPES)
        share = gap / np.maximum(lines.n_words, 1)
        gradient[SHAPES:width] = np.bincount(lines.words, share[lines.word_line], minlength=BUCKETS)
        held = of_line[at].astype(np.int64)  # the label before is the same
        gradient[width:] = pair.sum(axis=0) - np.array([(held == 0).sum(), 0, 0, (held == 1).sum()])
        return log_loss(lines, scores, ties, of_line) + penalty / 2 * (x @ x), gradient + penalty * x

    x = minimised(loss, np.zeros(width + 4), rounds)
    return x[:width], x[width:]


def log_loss(lines: Lines, scores: np.ndarray, ties: np.ndarray, of_line: np.ndarray) -> float:
    """Minus the logarithm of the likelihood of the labels: chain rule over lines, each given what comes after."""
    if not len(scores):
        return 0.0
    place = np.arange(len(scores)) - np.repeat(lines.first, lines.per_doc)
    bad, good = np.exp(np.minimum(0, -scores)), np.exp(np.minimum(0, scores))
    tie = np.exp(ties - ties.max())
    step = np.stack([tie[0] * bad, tie[1] * good, tie[2] * bad, tie[3] * good], axis=1)
    first = lines.first
    step[first] = np.stack([bad[first], good[first], bad[first], good[first]], axis=1)
    forward = products(step, place)[:, :2]
    forward /= forward.sum(axis=1, keepdims=True)
    # the factor by which each line scales the forward message is that line's share of the normaliser
    at = np.flatnonzero(place > 0)
    scale = bad + good
    scale[at] = (forward[at - 1, :1] * step[at, :2] + forward[at - 1, 1:] * step[at, 2:]).sum(axis=1)
    label = of_line.astype(np.int64)
    own = np.where(label == 1, np.minimum(0, scores), np.minimum(0, -scores))
    own[at] += (ties - ties.max())[label[at] * 3]
    return float(np.log(scale).sum() - own.sum())


def minimised(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """A minimum of a smooth function by limited-memory quasi-Newton steps with step halving."""
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.sqrt(gradient @ gradient))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            direction += s * (a - (y @ direction) / (s @ y))
        size, slope = 1.0, gradient @ direction
        while size > 1e-9:
            there = x - size * direction
            now, ahead = loss(there)
            if now <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (there - x) @ (ahead - gradient) > 1e-12:
            steps = [*steps[-memory + 1 :], (there - x, ahead - gradient)]
        done = value - now < 1e-6 * max(1.0, abs(now))
        x, value, gradient = there, now, ahead
        if done:
            break
    return x


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """The field from at most `sample` marked documents that are not held out; None if there is no mark to learn.

    `labels` has (doc_id, quality). Ids with null, other or both marks are not learned from, nor are documents of more than
    LINES lines. What comes to the driver is numbers of features, not text.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("mark"), F.max("quality").alias("high")).where("mark = high")
    chosen = marks.select("doc_id", "mark").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            lines = lines_of(rows["text"])
            first, words = lines.first, np.append(0, np.cumsum(lines.n_words))
            for k, mark in enumerate(rows["mark"].to_pylist()):
                if lines.per_doc[k] > LINES:
                    continue
                a, b = first[k], first[k] + lines.per_doc[k]
                values = [mark, lines.length[a:b].astype("<i4").tobytes(), lines.n_words[a:b].astype("<i4").tobytes()]
                values += [lines.cells[a:b].astype("<i2").tobytes(), lines.words[words[a] : words[b]].astype("<i2").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([rows["doc_id"][k].as_py()], pa.int64()), *[pa.array([v]) for v in values]], ["doc_id", "mark", "length", "n_words", "cells", "words"])

    columns = "doc_id long, mark long, length binary, n_words binary, cells binary, words binary"
    found = texts.select(F.col("doc_id").cast("long"), "text", F.col("mark").cast("long")).mapInArrow(featured, columns)
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["cells"], r["words"]))  # the same sums on every run
    if len({r["mark"] for r in rows}) < 2:
        return None
    length, n_words, cells, words = (np.frombuffer(b"".join(r[c] for r in rows), t).astype(np.int64) for c, t in (("length", "<i4"), ("n_words", "<i4"), ("cells", "<i2"), ("words", "<i2")))
    per_doc = np.array([len(r["length"]) // 4 for r in rows])
    lines = Lines(per_doc, length, cells.reshape(-1, PER_LINE), words, np.repeat(np.arange(len(length)), n_words), n_words)
    return fitted(lines, np.array([r["mark"] for r in rows]))


def line_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines) of each row of `docs`, from its text alone.

    score is the length-weighted mean of P(good) over the lines; a text without a character has one line, whose own marginal
    it is. Without marks of both kinds to learn from every score is 0.5. Other columns are not read.
    """
    model = fit_quality(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            lines = lines_of(rows["text"])
            if model is None:
                good = np.full(len(lines.length), 0.5)
            else:
                good = marginals(lines, own_scores(lines, model[0]), model[1])[0]
            doc = np.repeat(np.arange(len(lines.per_doc)), lines.per_doc)
            weight = np.where(np.bincount(doc, lines.length, minlength=len(lines.per_doc))[doc] > 0, lines.length, 1)
            scores = np.bincount(doc, good * weight) / np.bincount(doc, weight)
            columns = {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": np.clip(scores, 0, 1), "n_lines": lines.per_doc}
            yield from pa.table(columns).to_batches(max_chunksize=10_000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, n_lines long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
