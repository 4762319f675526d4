"""Seeded splits and folds.

Rows are put in the order of md5(id, seed) and cut at exact ranks, so that sizes are exact and membership never
depends on partitioning. The cut keys are found by counting key prefixes, level by level, in small
aggregates; assigning a row is then a comparison with a few constants, with no shuffle, window or sort of
the rows themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import side_by_side

HEX_PER_LEVEL = 3
AFTER_ALL_KEYS = "~"


def order_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"#{seed}")).cast("binary"))


def class_counts(df: DataFrame, label: str | None) -> dict:
    """Rows per class, in class order, NULL last; one class named None when there is no label."""
    if label is None:
        return {None: df.count()}
    rows = df.groupBy(label).count().collect()
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: (r[label] is None, r[label] if r[label] is not None else 0))}


def cut_keys(df: DataFrame, row_id: str, seed: int, label: str | None, ranks: dict) -> dict:
    """For each class and wanted rank, a text that exactly the first `rank` keys of the class do not exceed.

    Each level counts keys by the next hex digits behind the prefixes still open, so the driver sees at most
    4096 counts per open prefix, whatever the number of rows.
    """
    keyed = df.select(order_key(row_id, seed).alias("k"), (F.col(label) if label else F.lit(None)).alias("c"))
    found = {(c, r): "" for c, wanted in ranks.items() for r in wanted if r == 0}
    open_cuts = {(c, r): ("", r) for c, wanted in ranks.items() for r in wanted if r > 0}
    length = 0
    while open_cuts:
        if length >= 32:
            raise ValueError(f"{row_id} is not unique")
        prefixes = sorted({p for p, _ in open_cuts.values()})
        length += HEX_PER_LEVEL
        part = keyed if prefixes == [""] else keyed.where(F.substring("k", 1, length - HEX_PER_LEVEL).isin(prefixes))
        counts: dict = {}
        for row in part.groupBy("c", F.substring("k", 1, length).alias("p")).count().collect():
            counts.setdefault((row["c"], row["p"][: length - HEX_PER_LEVEL]), []).append((row["p"], row["count"]))
        still = {}
        for (c, r), (prefix, left) in open_cuts.items():
            for bucket, size in sorted(counts.get((c, prefix), [])):
                if left < size:
                    still[(c, r)] = (bucket, left)
                    break
                left -= size
                if left == 0:
                    found[(c, r)] = bucket + AFTER_ALL_KEYS
                    break
            else:
                raise ValueError(f"class {c!r} has fewer than {r} rows")
        open_cuts = still
    return found


def _assign(df, row_id, seed, label, plan, out) -> DataFrame:
    """Add `out` from a plan {class: [size of part 0, size of part 1, ...]} that uses up each class."""
    ranks = {c: [sum(sizes[: i + 1]) for i in range(len(sizes) - 1)] for c, sizes in plan.items()}
    cuts = cut_keys(df, row_id, seed, label, {c: sorted(set(r)) for c, r in ranks.items()})
    key = order_key(row_id, seed)
    choice = None
    for c, sizes in plan.items():
        part = F.lit(len(sizes) - 1)
        for i in reversed(range(len(sizes) - 1)):
            part = F.when(F.col("__key") <= F.lit(cuts[(c, ranks[c][i])]), F.lit(i)).otherwise(part)
        if label is None:
            choice = part
        else:
            condition = F.col(label).eqNullSafe(F.lit(c))
            choice = F.when(condition, part) if choice is None else choice.when(condition, part)
    if choice is None:
        choice = F.lit(None)
    return df.withColumn("__key", key).withColumn(out, choice.cast("int")).drop("__key")


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "email_id", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: ceil(share * n) rows in all, divided over the classes (NULL is one) by largest remainder."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    wanted = math.ceil(round(test_share * total, 9))
    exact = {c: n * wanted / total for c, n in counts.items()} if total else {}
    sizes = {c: math.floor(e) for c, e in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (-(exact[c] - sizes[c]), c is None, c if c is not None else 0))
    for c in by_remainder[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    plan = {c: [sizes[c], counts[c] - sizes[c]] for c in counts}
    split = _assign(df, row_id, seed, label, plan, "__part")
    return split.withColumn("is_test", F.col("__part") == 0).drop("__part")


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "label", row_id: str = "email_id", seed: int = 42
) -> DataFrame:
    """Add `fold` 0..k-1. Sizes are those of dealing the rows, sorted by class, to the folds in turn."""
    counts = class_counts(df, label)
    if k < 2 or not counts or max(counts.values()) < k:
        raise ValueError(f"cannot make {k} folds of classes with {counts} rows")
    plan, start = {}, 0
    for c, n in counts.items():
        plan[c] = [len(range((fold - start) % k, n, k)) for fold in range(k)]
        start += n
    return _assign(df, row_id, seed, label, plan, "fold")


def plain_folds(df: DataFrame, k: int = 5, row_id: str = "email_id", seed: int = 42) -> DataFrame:
    """Add `fold` 0..k-1 without regard to class; the first n % k folds have one row more."""
    (n,) = class_counts(df, None).values()
    if k < 2 or n < k:
        raise ValueError(f"cannot make {k} folds of {n} rows")
    return _assign(df, row_id, seed, None, {None: [n // k + (fold < n % k) for fold in range(k)]}, "fold")


def each_fold(df: DataFrame, k: int, run: Callable[[DataFrame, DataFrame, int], object], width: int = 4) -> list:
    """The results of `run(train, held_out, fold)` for every fold, several folds at a time."""

    def job(fold: int) -> Callable:
        return lambda: run(df.where(F.col("fold") != fold), df.where(F.col("fold") == fold), fold)

    return side_by_side(df.sparkSession, [job(fold) for fold in range(k)], width)
