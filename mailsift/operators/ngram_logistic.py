"""Cross-validated logistic regression on tf-idf of all n-grams, where these outnumber the rows by far.

The weights of an L2 regression are a sum of the rows' vectors, each times a number: w = X'v. So what is fitted has one number for each
row and fold, however many n-grams there are, and the vocabulary never leaves the tasks. Each step of the fit is a Spark job over the
postings: it sums v over the rows of each n-gram and adds the sums up again for each row, which is X(X'v). An n-gram that occurs in
one row only takes part in that row's own product alone, so these are kept as one number for each row and n-gram length.

The driver holds some vectors with a number for each row and fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from . import grams

#: Postings of a block, at least.
BLOCK = 200_000
#: Rows whose sums travel together.
SPAN = 1 << 14
#: What a block holds, as bytes, which pass between the JVM and Python as they are.
BLOCKS = {"at": np.int32, "n": np.int32, "size": np.int32, "square": np.float64, "one_at": np.int32, "one": np.float64}


def numbered(rows: DataFrame) -> DataFrame:
    """Add `row`, from 0 on without gaps. The rows have to be a stored table with the column `place`, a monotonically_increasing_id."""
    part = F.shiftright("place", 33)
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())
    begins = np.append(0, np.cumsum([n for _, n in counts]))[:-1].tolist()
    first = F.create_map(*[F.lit(x) for (p, _), b in zip(counts, begins, strict=True) for x in (p, b)])
    return rows.withColumn("row", F.element_at(first, part) + F.col("place").bitwiseAND((1 << 33) - 1))


def blocks(rows: DataFrame, words: str, length: int, k: int, train_rows: list[int], block: int = BLOCK) -> DataFrame:
    """The postings of all n-grams of one length, in blocks: rows and counts of those that occur in several rows, how many postings each
    n-gram has, its squared idf in each fold, and for each row the sum of squared counts of n-grams that occur in it only."""
    size = np.array(train_rows, float)

    def block_of(cell: np.ndarray, n: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(new)
        per = np.diff(np.append(first, len(cell)))
        row, fold = cell // k, cell % k
        single, several = np.repeat(per == 1, per), per > 1
        one_at, place = np.unique(row[single], return_inverse=True)
        one = np.bincount(place, n[single].astype(float) ** 2, minlength=len(one_at))
        term = np.repeat(np.arange(several.sum()), per[several])
        inside = np.bincount(term * k + fold[~single], minlength=several.sum() * k).reshape(-1, k)
        seen = per[several][:, None] - inside  # rows of the n-gram that the model of each fold is fitted on
        idf = np.where(seen > 0, np.log((1 + size) / (1 + seen)) + 1, 0.0)
        columns = [row[~single], n[~single], per[several], (idf * idf).ravel(), one_at, one]
        binaries = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(columns, BLOCKS.values(), strict=True)]
        return pa.RecordBatch.from_arrays(binaries, list(BLOCKS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b", "cell", "n")])
            total += batch.num_rows
            if total < block:
                continue
            a, b, cell, n = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            last = int(np.flatnonzero(new)[-1])  # the last n-gram may go on
            if last:
                yield block_of(cell[:last], n[:last], new[:last])
            held = [[x[last:] for x in (a, b, cell, n)]]
            total = len(a) - last
            if not last:
                total = 0  # one n-gram fills the block: gather as much again
        if held:
            a, b, cell, n = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(a):
                yield block_of(cell, n, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))

    # the row's fold travels with its number
    given = rows.select(words, (F.col("row") * k + F.col("fold")).alias("cell"))
    counts = grams.counted(given, words, (length, length), "cell").withColumnRenamed("row", "cell")
    ordered = counts.repartition("a").sortWithinPartitions("a", "b", "cell").select("a", "b", "cell", "n")
    return write_and_read(ordered.mapInArrow(gather, ", ".join(f"{c} binary" for c in BLOCKS)), "postings")


def record_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[i].as_buffer(), BLOCKS[c]) for c in batch.schema.names]


def per_row(postings: DataFrame, columns: list[str], n: int, width: int, work) -> np.ndarray:
    """The sum over all tasks of what `work` adds to a matrix, of which it gets the transpose, with `n` rows."""
    span = max(1, SPAN // width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, n))
        for arrays in record_arrays(batches):
            work(out, *arrays)
        for first in range(0, n, span):
            part = out[:, first : first + span].T.ravel()
            lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
            yield pa.RecordBatch.from_arrays([pa.array([first // span], pa.int64()), lists], ["span", "total"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                part = batch.column(1)[i].values.to_numpy()
                totals[at] = totals[at] + part if at in totals else part.copy()
        for at, part in totals.items():
            lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), lists], ["span", "total"])

    kind = "span long, total array<double>"
    spans = -(-n // span)
    cores = postings.sparkSession.sparkContext.defaultParallelism
    # each task sends a matrix, so there are no more than can run at a time
    summed = postings.select(*columns).coalesce(cores).mapInArrow(add, kind).repartition(min(cores, spans), "span").mapInArrow(meet, kind)
    out = np.zeros((n, width))
    table = summed.toArrow()
    for at, part in zip(table["span"].to_pylist(), table["total"], strict=True):
        out[at * span : (at + 1) * span] = part.values.to_numpy().reshape(-1, width)
    return out


@dataclass
class Products:
    """X(X'v) for the tf-idf vectors of all rows and every fold at once; unit length, but for rows without a known n-gram."""

    postings: DataFrame
    scale: np.ndarray  # rows by folds: one over the length
    own: np.ndarray  # rows by folds: what n-grams of the row alone add to its product with itself

    def __call__(self, v: np.ndarray) -> np.ndarray:
        """`v` is rows by folds by vectors."""
        n, k, m = v.shape
        spark = self.postings.sparkSession
        sent = spark.sparkContext.broadcast(np.ascontiguousarray((v * self.scale[:, :, None]).reshape(n, k * m).T))

        def work(out, at, count, size, square) -> None:
            if not len(size):
                return
            at, count, square = at.astype(np.int64), count.astype(float), square.reshape(-1, k)
            firsts = np.cumsum(size) - size
            for j, column in enumerate(sent.value):
                sums = np.add.reduceat(column.take(at) * count, firsts) * square[:, j // m]
                out[j] += np.bincount(at, np.repeat(sums, size) * count, minlength=n)

        try:
            total = per_row(self.postings, ["at", "n", "size", "square"], n, k * m, work)
        finally:
            sent.unpersist()
        return total.reshape(n, k, m) * self.scale[:, :, None] + self.own[:, :, None] * v


def products(parts: list[DataFrame], in_train: np.ndarray) -> Products:
    """From the blocks of each n-gram length; `in_train` is rows by folds."""
    postings = reduce(DataFrame.unionByName, parts)
    n, k = in_train.shape

    def lengths(out, at, count, size, square, one_at, one) -> None:
        squared, square = count.astype(float) ** 2, square.reshape(-1, k)
        for j in range(k):
            out[j] += np.bincount(at, np.repeat(square[:, j], size) * squared, minlength=n)
        out[k] += np.bincount(one_at, one, minlength=n)

    found = per_row(postings, ["at", "n", "size", "square", "one_at", "one"], n, k + 1, lengths)
    # an n-gram of one row is known to the folds that train on the row
    idf = np.log((1 + in_train.sum(axis=0)) / 2) + 1
    alone = found[:, k:] * (idf * idf) * in_train
    squared = found[:, :k] + alone
    scale = np.divide(1.0, np.sqrt(squared), out=np.zeros_like(squared), where=squared > 0)
    return Products(postings, scale, alone * scale * scale)


def solved(times, root: np.ndarray, x: np.ndarray, rest: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conjugate gradients for all folds at once among vectors without a part along `root`: from x with the residual `rest` under
    x + root K root x to one with a residual of length `goal` at most. Also what is added to K root x on the way."""
    length = np.maximum((root * root).sum(axis=0), 1e-300)

    def across(z: np.ndarray) -> np.ndarray:
        return z - root * ((root * z).sum(axis=0) / length)

    x, added, rest = x.copy(), np.zeros_like(x), across(rest)
    along, square = rest.copy(), (rest * rest).sum(axis=0)
    for _ in range(len(x) + 10):
        if (square <= goal * goal).all():
            break
        times_along = times((root * along)[:, :, None])[:, :, 0]
        image = across(along + root * times_along)
        bend = (along * image).sum(axis=0)
        step = np.divide(square, bend, out=np.zeros_like(square), where=(bend > 0) & (square > goal * goal))
        x += step * along
        added += step * times_along
        rest -= step * image
        next_square = (rest * rest).sum(axis=0)
        along = rest + np.divide(next_square, square, out=np.zeros_like(square), where=square > 0) * along
        square = next_square
    return x, added


def margins(times, label: np.ndarray, in_train: np.ndarray, max_iter: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """The log odds of label 1 of every row by the model of every fold: L2 logistic regression with unit inverse strength and a free
    intercept, by Newton's method. A fold trained on one class gives infinite odds for it.

    The free intercept holds the sum of v at zero, so steps are looked for among such vectors, and each as exactly as it is worth: to
    the gradient that is left, squared."""
    y, weigh = label[:, None].astype(float), in_train.astype(float)
    rows, ones = weigh.sum(axis=0), (weigh * y).sum(axis=0)
    mixed = (ones > 0) & (ones < rows)
    weigh = weigh * mixed
    share = np.where(mixed, ones / np.maximum(rows, 1), 0.5)
    v, shift = np.zeros(in_train.shape), np.log(share / (1 - share))
    product = np.zeros(in_train.shape)

    def loss(product, v, shift):
        odds = product + shift
        return (weigh * (np.logaddexp(0, odds) - y * odds)).sum(axis=0) + (v * product).sum(axis=0) / 2

    for _ in range(max_iter):
        odds = product + shift
        p = 1 / (1 + np.exp(-odds))
        off = weigh * (y - p - v)
        worst = np.abs(off).max(axis=0, initial=0)
        if worst.max(initial=0) <= tolerance and np.abs(v.sum(axis=0)).max(initial=0) <= tolerance:
            break
        bend = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        root, rest = weigh * bend, off / bend
        goal = np.maximum(np.minimum(worst, 0.1) * np.sqrt((rest * rest).sum(axis=0)), tolerance / 10)
        x, added = solved(times, root, weigh * v / bend, rest, goal)
        new_v, new_product = root * x, product + added
        # what is left of the equations along `root` is the intercept
        left = root * odds + weigh * (y - p) / bend - x - root * new_product
        new_shift = np.where(mixed, (root * left).sum(axis=0) / np.maximum((root * root).sum(axis=0), 1e-300), shift)
        before, step = loss(product, v, shift), np.ones(len(shift))
        for _ in range(30):  # shorter steps where the loss would rise
            tried = [old + step * (new - old) for old, new in ((product, new_product), (v, new_v), (shift, new_shift))]
            worse = loss(*tried) > before + 1e-9 * np.abs(before)
            if not worse.any():
                break
            step = np.where(worse, step / 2, step)
        product, v, shift = tried
    return np.where(mixed, product + shift, np.where(ones > 0, np.inf, -np.inf))
