"""Mixing sources to target weights by systematic sampling.

Each source gets a target; each of its documents then expects target / source size copies. Along an order of the source's
documents (by size, then by hash) the expected copies are summed up, one random offset per source is added, and a document
is taken once for each integer that its stretch of the sum crosses. As neighbours have like sizes, the words taken stay
near the target. The sums are built in three levels (classes of size, blocks of a class, rows of a block), so that no task
holds a whole source, however large. Sums are whole numbers of 2^-24 copies: any order of addition gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.session import write_and_read

UNIT = 1 << 24
WEIGHTS = (3, 1, 2)
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words."""
    return docs.select("doc_id", "source", F.regexp_count(common.whole(), F.lit(common.WORD)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """One row per source: its number in code point order (null last), size and target.

    `percent` of all words are shared out by weight. A target stops at `most` times its source's size, and the excess goes
    to the others by weight: with sources in order of (cap / weight), the level at which the rest is shared out is found
    from running sums over this table of sources.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1)
    per_source = per_source.withColumn("number", F.row_number().over(ordered)).withColumn("weight", weight)
    per_source = per_source.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * percent / 100.0 - F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap")
    level = left / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per_source = per_source.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("weight"))
    shared = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(shared, F.lit(float("inf"))) * F.col("weight"))
    return per_source.select("source", "number", "source_size", target.alias("target"))


def hashed(*parts: Column | str, digits: int) -> Column:
    """A number from the first hexadecimal digits of the md5 of the parts."""
    text = F.concat_ws(":", F.lit(SEED), *parts)
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """64 classes for each doubling of the size, in its order."""
    extra = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return (64 * extra + F.floor(size / F.pow(F.lit(2.0), extra))).cast("int")


def mix(docs: DataFrame, rows: DataFrame | None = None, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies, for each row of `docs`.

    `rows` may be the same documents with columns to carry along: it needs doc_id, source and size, and keeps the rest.
    A null text has size 0 and a null source is a source. Rows with the same doc_id count each for itself; which of them
    gets the extra copy is fixed by their size. A source without words gets nothing.
    """
    narrow = write_and_read(sizes(docs), "mix-sizes")
    per_source = targets(narrow, **shares)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0)
    per_source = write_and_read(per_source.withColumn("expected", expected.cast("long")), "mix-sources")

    def placed(these: DataFrame) -> DataFrame:
        known = per_source.withColumnRenamed("source", "of_source")
        these = these.join(known, these["source"].eqNullSafe(known["of_source"])).drop("of_source")
        these = these.withColumn("class", size_class(F.col("size"))).withColumn("place", hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), digits=8))
        return these.withColumn("block", F.shiftright("place", 24).cast("int"))

    block = ["number", "class", "block"]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed(narrow).groupBy(*block).agg(F.sum("expected").alias("mass"))
    classes = blocks.groupBy("number", "class").agg(F.sum("mass").alias("mass"))
    class_start = F.coalesce(F.sum("mass").over(before(Window.partitionBy("number").orderBy("class"))), F.lit(0))
    classes = classes.select("number", "class", class_start.alias("class_start"))
    block_start = F.coalesce(F.sum("mass").over(before(Window.partitionBy("number", "class").orderBy("block"))), F.lit(0))
    starts = blocks.withColumn("start", block_start).join(classes, ["number", "class"])
    starts = starts.select(*block, (F.col("start") + F.col("class_start")).alias("start"))
    within = Window.partitionBy(*block).orderBy("size", "place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = placed(narrow if rows is None else rows).join(starts, block)
    end = F.col("start") + F.sum("expected").over(within) + hashed(F.lit("offset"), F.coalesce("source", F.lit("-")), digits=6)
    out = out.withColumn("end", end)
    copies = F.floor(F.col("end") / UNIT) - F.floor((F.col("end") - F.col("expected")) / UNIT)
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    own = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    return out.select(*own, *([] if rows is None else [c for c in rows.columns if c not in ("doc_id", "source", "size")]))


def mixed(docs: DataFrame, **shares) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their columns and no other."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mixed_row")
    size = F.regexp_count(common.whole(), F.lit(common.WORD)).cast("long").alias("size")
    chosen = mix(docs, docs.select("doc_id", "source", size, row), **shares).where("copies > 0")
    return chosen.select(F.explode(F.expr("array_repeat(mixed_row, int(copies))")).alias("mixed_row")).select("mixed_row.*")
