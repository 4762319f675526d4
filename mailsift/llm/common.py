"""What the operators of this package share: table access, Arrow batches of bounded size, words as arrays."""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words are runs of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at a time.
CHUNK = (2 << 20) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches hold 1,000 rows then, as rows with long texts make wide batches."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def tidied(work):
    """`work` of a task, which gives freed memory back to the system at its end: a worker goes on to other tasks, or waits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
                trim(0)

    return run


def one_thread() -> None:
    """Batches of the tokenizers library run on the task's own thread in this process, unless its variable says otherwise: each core
    has a task of its own, and threads that wait for each other's work take CPU time from them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.Table]:
    """Rows in tables of about `size` bytes of `column`; a longer text is a table of its own."""
    held, held_bytes = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        first, total = 0, held_bytes
        for row, length in enumerate(lengths.tolist()):
            if total and total + length > size:
                held.append(batch.slice(first, row - first))
                yield pa.Table.from_batches(held).combine_chunks()
                held, first, total = [], row, 0
            total += length
        held.append(batch.slice(first))
        held_bytes = total
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def text_bytes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of `marks` within each text."""
    out, full = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(marks, offsets[:-1][full], dtype=np.int64)
    return out


def often(met: np.ndarray, most: int) -> np.ndarray:
    """Marks the entries met more than once, the `most` that were met most often at most."""
    kept = met > 1
    if kept.sum() > most:
        kept = np.zeros(len(met), bool)
        kept[np.argpartition(met, len(met) - most)[len(met) - most :]] = True
    return kept


def renumbered(known: dict[str, int], kept: np.ndarray) -> dict[str, int]:
    """The kept entries of a table numbered in order, numbered anew."""
    return {x: i for i, x in enumerate(itertools.compress(known, kept.tolist()))}


#: Base of the polynomial hash of bytes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def powers(base: int, bits: int) -> np.ndarray:
    """base^i modulo 2^64 for i below 2^bits."""
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
    return out


@dataclass
class Runs:
    """Runs of bytes of one class within texts: where each begins and ends, and which text it is in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray

    def hashed(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each run; where a run lies does not matter."""
        bits = max(20, len(data).bit_length())
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, bits)[: len(data)], out=prefix[1:])
        return mixed((prefix[self.end] - prefix[self.start]) * powers(INVERSE, bits)[self.start])


def runs(classes: np.ndarray, offsets: np.ndarray) -> Runs:
    """Maximal runs of equal non-zero class that do not cross the end of a text."""
    cut = np.ones(len(classes) + 1, bool)
    cut[1:-1] = classes[1:] != classes[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    kept = classes[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[kept], end[kept]
    per_doc = np.diff(np.searchsorted(start, offsets))
    return Runs(start, end, np.repeat(np.arange(len(offsets) - 1), per_doc), per_doc)


def words(data: np.ndarray, offsets: np.ndarray) -> Runs:
    return runs((~SPACE[data]).view(np.uint8), offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` neighbours, from the hashes of its members in order."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= np.uint64(BASE)
        out += hashes[k : k + n]
    return mixed(out)
