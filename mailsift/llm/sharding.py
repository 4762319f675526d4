"""Sharding by sampled splitters, shards of nearly equal bytes.

Rows are ordered by the hash of their text, then of their id, so that equal texts are neighbours. A sample of rows, drawn
with probability in proportion to their size, gives quantiles of this order; they cut it into ranges. A text so common that
it takes several quantiles, of bytes or (if it is short) of rows, gets a range of its own. Overfull ranges are subdivided,
and from the exact sizes of the ranges and of their parts every row knows how many bytes and rows lie before it: that gives its shard and its slot.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.session import write_and_read

#: Quantiles that are asked for, and sampled rows for each of them.
RANGES = 255
SAMPLE = 64
#: A range with more rows than this many times the average is subdivided, and any with more rows than FULL.
OVERFULL = 2
FULL = 100_000
LARGEST = (1 << 63) - 1
#: Bits of a key that a splitter lacks. A range of one splitter is that wide, and holds one key but for chance.
SHORT = 11


def keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, size, text_crc32, and the two parts of the order."""
    size = F.octet_length(common.whole()).cast("long") + 1
    crc = F.crc32(F.encode(common.whole(), "UTF-8"))
    return docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(common.whole()).alias("key"),
        F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 31)).alias("minor"), *carried,
    )


def splitters(narrow: DataFrame, total: int, count: int, ranges: int = RANGES, sample: int = SAMPLE) -> tuple[list[int], list[int]]:
    """Quantiles of the order from a size-weighted sample and from one of rows; at most `ranges` of each, with repeats. They are
    of keys without their last SHORT bits, as the sketch of the quantiles holds doubles."""
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id", "key"), F.lit(1 << 31)) / float(1 << 31)
    steps = [k / (ranges + 1) for k in range(1, ranges + 1)]
    drawn = lambda weight, whole: F.when(chance < weight * (ranges * sample / max(whole, 1)), F.shiftright("key", SHORT))
    keys = drawn(F.col("size"), total), drawn(F.lit(1), count)
    found = narrow.agg(*(F.percentile_approx(key, steps, 100 * ranges) for key in keys)).first()
    return found[0] or [], found[1] or []


def bounds(cuts: list[int], by_rows: list[int] = ()) -> list[int]:
    """Where ranges begin. A key that is a quantile more than once, of bytes or of rows, begins a range, and so does the next key."""
    hot = {k for k, n in [*Counter(cuts).items(), *Counter(by_rows).items()] if n > 1}
    return sorted({*cuts, *hot, *(k + 1 for k in hot if k < LARGEST)})


def position(key: Column, begins: list[int]) -> Column:
    """How many of `begins` are at most the key, by binary search."""
    bits = max(1, len(begins).bit_length())
    padded = F.lit(begins + [LARGEST] * ((1 << bits) - len(begins)))
    step = lambda at, bit: at + F.when(F.element_at(padded, at + bit) <= key, bit).otherwise(0)
    return F.aggregate(F.lit([1 << b for b in reversed(range(bits))]), F.lit(0), step)


def shards(docs: DataFrame, n: int = 16, full: int = FULL, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of `docs`; with `carry` also the whole row as `shard_row`.

    A null text has no bytes, and each row counts one byte more. Rows with equal id and text are exchangeable, and null ids
    are as any other. An empty table gives no rows. Equal texts share a shard unless a shard ends among them.
    """
    narrow = write_and_read(keyed(docs), "shard-keys")
    total, count = narrow.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    begins = [b << SHORT for b in bounds(*splitters(narrow, total, count)) if b << SHORT <= LARGEST]
    number = position(F.col("key"), begins).alias("number")
    found = narrow.groupBy(number).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    # one entry for each range: at most three times RANGES and one
    rows, sizes = ([0] * (len(begins) + 1) for _ in range(2))
    for r in found:
        rows[r["number"]], sizes[r["number"]] = r["rows"], r["bytes"]
    full = min(full, max(1, OVERFULL * sum(rows) // RANGES))
    parts = F.lit([max(1, -(-r // full)) for r in rows])
    low = [-LARGEST - 1, *begins]
    width = [float(b - a) for a, b in zip(low, [*begins, LARGEST], strict=True)]
    of = lambda values: F.element_at(F.lit(values), F.col("number") + 1)

    def parted(these: DataFrame) -> DataFrame:
        these = these.withColumn("number", number).withColumn("parts", F.element_at(parts, F.col("number") + 1))
        share = (F.col("key").cast("double") - of([float(x) for x in low])) / of(width)
        share = F.when(of(width) <= 1 << SHORT, F.col("minor") / float(1 << 31)).otherwise(share)
        part = F.least(F.col("parts") - 1, F.greatest(F.lit(0), F.floor(share * F.col("parts"))))
        return these.withColumn("part", part.cast("int")).drop("parts")

    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    block = parted(narrow).groupBy("number", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    starts = block.select(
        "number", "part",
        (of([0, *accumulate(rows)][:-1]) + F.coalesce(F.sum("rows").over(before), F.lit(0))).cast("long").alias("rows_start"),
        (of([0, *accumulate(sizes)][:-1]) + F.coalesce(F.sum("bytes").over(before), F.lit(0))).cast("long").alias("bytes_start"),
    )
    starts = write_and_read(starts, "shard-starts")

    def placed(these: DataFrame) -> DataFrame:
        order = Window.partitionBy("number", "part").orderBy("key", "minor", "doc_id", "size")
        these = parted(these).join(starts, ["number", "part"])
        these = these.withColumn("row", F.col("rows_start") + F.row_number().over(order) - 1)
        running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        middle = 2 * (F.col("bytes_start") + running) - F.col("size")
        return these.withColumn("shard", F.least(F.lit(n - 1), F.floor(middle * n / float(2 * max(total, 1)))).cast("int"))

    firsts = {r["shard"]: r["first"] for r in placed(narrow).groupBy("shard").agg(F.min("row").alias("first")).collect()}
    out = placed(keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("shard_row")) if carry else narrow)
    first = F.element_at(F.lit([firsts.get(k, 0) for k in range(n)]), F.col("shard") + 1)
    columns = ["doc_id", "size", "text_crc32", "shard", (F.col("row") - first).cast("long").alias("slot")]
    return out.select(*columns, *(["shard_row"] if carry else []))


def write_shards(docs: DataFrame, folder: str, n: int = 16) -> None:
    """The rows of `docs` in one folder per shard, `shard=0` and so on, in the order of their slots within each file."""
    rows = shards(docs, n, carry=True).select("shard_row.*", F.col("shard").alias("shard"))
    rows.write.partitionBy("shard").parquet(folder)


def range_of(key: int, begins: list[int]) -> int:
    """What `position` computes, for tests."""
    return bisect_right(begins, key)
