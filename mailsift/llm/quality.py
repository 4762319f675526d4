"""Quality rules: n-gram log-likelihood ratio of trusted text against the raw corpus.

Words and runs of punctuation, and pairs of neighbours among them, are hashed into a fixed number of buckets. One
multinomial is counted over every trusted document, another over every document. A document's score is the mean log ratio
of its n-grams, so that length does not count, and a fixed threshold decides for each document by itself. Equality of
lines and of windows of words within a document is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm import common

#: Size of the two multinomials. It bounds what a task emits and what is sent to the tasks that score.
BUCKETS = 1 << 15
#: Trusted ids that are sent to all tasks, at most: some 50 bytes for each.
SENT = 1_000_000
#: Lowest kept score, in nats per n-gram.
THRESHOLD = -0.3
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: 0 blank, 1 part of a word, 2 punctuation. Bytes of characters beyond ASCII count as parts of words.
CLASS = np.full(256, 2, np.uint8)
CLASS[common.SPACE] = 0
CLASS[[i for i in range(256) if i >= 128 or chr(i).isalnum() or i == 95]] = 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of length 1 and 2, and its document."""
    tokens = common.runs(CLASS[data], offsets)
    hashes = tokens.hashed(data)
    together = tokens.doc[1:] == tokens.doc[:-1]
    grams = np.concatenate([hashes, common.windows(hashes, 2)[together]])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([tokens.doc, tokens.doc[1:][together]])


def counted(buckets: int):
    """For a task: how often each bucket occurs in its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for rows in common.gathered(batches):
            data, offsets = common.text_bytes(rows["text"])
            totals += np.bincount(features(data, offsets, buckets)[0], minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])

    return common.tidied(count)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of each bucket, from all of `docs` and those of them whose doc_id is in `trusted`.

    Each multinomial is mixed half and half with the uniform one, so that an n-gram missing in one corpus has a finite ratio
    and equal frequencies have ratio 0 at any size. With no trusted document at all every ratio is 0. A null doc_id is never
    trusted; repeated rows count each time. The raw corpus is counted in a plain scan. Only the trusted documents are joined:
    their ids go to all tasks up to SENT of them, as counted, and beyond that the texts with an id are shuffled.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("shuffle_hash")
    good = docs.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi")
    columns = "bucket long, n long"
    parts = docs.select("text").mapInArrow(counted(buckets), columns).withColumn("target", F.lit(0))
    parts = parts.union(good.select("text").mapInArrow(counted(buckets), columns).withColumn("target", F.lit(1)))
    totals = parts.groupBy("target", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most two rows a bucket
    counts = np.zeros((2, buckets))
    counts[totals["target"], totals["bucket"]] = totals["n"]
    return log_ratios(counts[1], counts[0])


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    uniform = 1 / len(raw)
    return np.log(target / target.sum() + uniform) - np.log(raw / raw.sum() + uniform)


def measured(texts: pa.Array | pa.ChunkedArray, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The measures of each text, by column."""
    data, offsets = common.text_bytes(texts)
    n = len(offsets) - 1
    space = common.SPACE[data]
    word = common.words(data, offsets)
    out = {"n_words": word.per_doc.astype(np.int64)}
    out["word_chars"] = common.sums(~space & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = common.sums(SYMBOL[data], offsets)
    out["n_dup_lines"] = repeated_lines(data, offsets, space)
    out["n_repeat_words"] = repeated_words(word.hashed(data), word.doc, n)
    few, repeats = out["n_words"] < 10, 100 * out["n_repeat_words"] > 20 * out["n_words"]
    out["base_failed"] = few | repeats
    bucket, doc = features(data, offsets, len(ratios))
    grams = np.bincount(doc, minlength=n)
    out["llr"] = np.bincount(doc, weights=ratios[bucket], minlength=n) / np.maximum(grams, 1)
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def repeated_lines(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    line = common.runs((data != 10).view(np.uint8), offsets)
    if not len(line.start):
        return np.zeros(len(offsets) - 1, np.int64)
    has_word = np.add.reduceat(~space, line.start, dtype=np.int64) > 0  # a line feed is a blank, so it adds nothing
    doc = line.doc[has_word]
    keys = in_document(line.hashed(data)[has_word], doc)
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.bincount(doc[order[again]], minlength=len(offsets) - 1)


def in_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document."""
    return common.mixed(hashes * np.uint64(common.BASE) + doc.astype(np.uint64))


def repeated_words(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words within windows of five words that occur twice or more in their text."""
    if len(hashes) < 5:
        return np.zeros(n, np.int64)
    keys = in_document(common.windows(hashes, 5), doc[4:])
    inside = np.flatnonzero(doc[4:] == doc[:-4])
    keys = keys[inside]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    at = inside[twice[place] == keys]
    covered = np.zeros(len(hashes), bool)
    for k in range(5):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n)


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of `docs`: doc_id, the base measures, `llr` and `kept`.

    A null or empty text has no words and fails; a null doc_id stays null; repeated rows give repeated rows; other columns
    of `docs` are not read.
    """
    ratios = fit(docs, trusted, buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            found = measured(rows["text"], ratios, threshold)
            yield from pa.table({"doc_id": rows["doc_id"], **found}).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(common.tidied(score), f"doc_id {kind}, {MEASURES}")


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns and no other."""
    ratios = fit(docs, trusted, buckets)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            yield from rows.filter(pa.array(measured(rows["text"], ratios, threshold)["kept"])).to_batches()

    return docs.mapInArrow(common.tidied(keep), docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not as toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
