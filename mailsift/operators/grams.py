"""Word n-grams as 128-bit hashes, made from hashes of their words; equality of n-grams is that of these hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffles_removed

#: Tokens that a task works on at a time, and n-grams that a group of them has at most.
CHUNK = 1 << 19
GROUP = 1 << 22
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: str) -> tuple[Column, Column]:
    """Two hashes of each word, with different seeds."""
    return F.transform(words, lambda w: F.xxhash64(w)).alias("a"), F.transform(words, lambda w: F.xxhash64(F.lit(1), w)).alias("b")


def windows(hashes: np.ndarray, owner: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of `length` words of one row."""
    n = max(0, len(hashes) - length + 1)
    out = hashes[:n] + np.uint64(length)
    for k in range(1, length):
        out = out * base + hashes[k : k + n]
    return mixed(out[owner[:n] == owner[length - 1 : length - 1 + n]])


def counted(df: DataFrame, words: str, ngram_range: tuple[int, int], row: str | None = None) -> DataFrame:
    """Occurrences (a, b, n) of each n-gram within some rows of a task, or (row, a, b, n) within each single row if `row` names a
    column of whole numbers that differ. Sums over (a, b) are those of all rows."""
    low, high = ngram_range

    def found(owners: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for length in range(low, high + 1):
            x, y = (windows(h.view(np.uint64), owner, length, base).view(np.int64) for h, base in zip((a, b), BASES, strict=True))
            n = max(0, len(owner) - length + 1)
            at = owner[:n][owner[:n] == owner[length - 1 : length - 1 + n]] if row else np.zeros(len(x), np.int64)
            order = np.lexsort((y, x, at))
            x, y, at = x[order], y[order], at[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (at[1:] != at[:-1])
            first = np.flatnonzero(new)
            columns = {"a": x[first], "b": y[first], "n": np.diff(np.append(first, len(x)))}
            if row:
                columns["row"] = owners[at[first]]
            yield from pa.table(columns).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def finish() -> Iterator[pa.RecordBatch]:
            return found(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            lists = batch.column("a")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            a, b = (batch.column(c).flatten().to_numpy() for c in ("a", "b"))
            held.append((batch.column("row").to_numpy(), sizes, a, b))
            size += len(a)
            if size > CHUNK:
                yield from finish()
                held, size = [], 0
        if size:
            yield from finish()

    given = df.where(F.size(words) > 0).select(*word_hashes(words), (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    return given.mapInArrow(run, f"a long, b long, n long{', row long' if row else ''}")


def distinct(df: DataFrame, words: str, length: int, occurrences: int, passes: int) -> int:
    """How many different n-grams of one length there are, given how often any occur.

    The n-grams are dealt by their hash over passes, and in a pass over groups that fit a task. A pass sends 16 bytes of each
    n-gram that a task meets in some rows, which are removed when it ends.
    """
    groups = max(1, -(-occurrences // (GROUP * passes)))
    spark, total = df.sparkSession, 0
    given = df.where(F.size(words) >= length).select(*word_hashes(words))
    for i in range(passes):
        with shuffles_removed(spark):
            sent = given.mapInArrow(partial(packed, length, passes, groups, i), "grp long, grams binary")
            sent = sent.repartition(min(groups, max(spark.sparkContext.defaultParallelism, groups // 4)), "grp").sortWithinPartitions("grp")
            total += sent.mapInArrow(different, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return total


def packed(length: int, passes: int, groups: int, i: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of pass i in some rows, as bytes by group. Sorted numbers share their first bytes, so each byte has a run of its own."""
    held, size = [], 0

    def finish() -> Iterator[pa.RecordBatch]:
        sizes, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        x, y = (windows(h.view(np.uint64), owner, length, base) for h, base in zip((a, b), BASES, strict=True))
        if passes > 1:
            mine = y % np.uint64(passes) == i
            x, y = x[mine], y[mine]
        order = np.argsort(x)
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y = x[new], y[new]
        ends = np.searchsorted(x, [(g << 64) // groups for g in range(groups)]).tolist() + [len(x)]
        found = [(g, x[c:d], y[c:d]) for g, (c, d) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if c < d]
        grams = [x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() + y.tobytes() for _, x, y in found]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in found], pa.int64()), pa.array(grams, pa.binary())], ["grp", "grams"])

    for batch in batches:
        sizes = batch.column("a").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        held.append((sizes, *(batch.column(c).flatten().to_numpy() for c in ("a", "b"))))
        size += len(held[-1][1])
        if size > CHUNK:
            yield from finish()
            held, size = [], 0
    if size:
        yield from finish()


def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many different n-grams each group of `packed` has; the rows are in the order of the groups."""
    now, held = None, []

    def count() -> pa.RecordBatch:
        x, y = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.argsort(x)
        x, y = x[order], y[order]
        same = x[1:] == x[:-1]
        if (y[1:][same] != y[:-1][same]).any():  # two n-grams share half of their hash
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        return pa.RecordBatch.from_arrays([pa.array([len(x) - int(same.sum())], pa.int64())], ["n"])

    for batch in batches:
        for group, grams in zip(batch.column("grp").to_pylist(), batch.column("grams"), strict=True):
            if group != now and held:
                yield count()
                held = []
            now = group
            octets = np.frombuffer(grams.as_buffer(), np.uint8)
            half = len(octets) // 2
            x = np.ascontiguousarray(octets[:half].reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)
            held.append((x, octets[half:].view(np.uint64)))
    if held:
        yield count()
