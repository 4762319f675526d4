"""Boosted trees on binned features, by gradients and curvatures of the logistic loss.

A model is fitted on all rows. Every feature is binned once at quantiles and trees are grown level by level from histograms over
bins. A task holds some `task_entries` entries: a smaller model is fitted in one task, so that models of different folds and feature
sets share the cluster. The features of a larger one are dealt over tasks, and each level of a tree is a job, in which the tasks find the
best split of each node and which rows go left; the driver then holds some vectors with a number for each row. Scores are computed
row by row where the rows are.

Zeros count as absent, as in a sparse matrix: each split learns on which side absent entries go. Gradients and curvatures are whole
numbers of a small unit, so that sums do not depend on the order of rows or on how features are dealt out.
"""

from __future__ import annotations

import io
import math
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .tfidf import vector_size

#: Features that are binned at a time.
BLOCK = 64
#: Cells of histograms, and entries, looked at in one go.
CELLS, ENTRIES = 1 << 17, 1 << 18
#: Keys by which a task's features are dealt to it.
KEYS = 8
#: What a task is sent of a batch of rows, and what is kept of a feature.
DEALT = "key int, task int, batch int, rows int, row binary, at binary, value binary"
KEPT = "feature int, rows long, dense boolean, row binary, code binary, upper binary"
#: Fits whose rows have numbers in the driver, at a time.
FAR = threading.BoundedSemaphore(3)
#: From (node of each row, gradients, curvatures, limits, least gain) to what `Features.search` returns.
Search = Callable[..., tuple[np.ndarray, ...]]


@dataclass(frozen=True)
class Booster:
    """Settings. `penalty` is on squared leaf weights; a split leaves at least `least` curvature on either side. The fit takes all rows
    unless `sample` names a number."""

    rounds: int = 150
    rate: float = 0.08
    depth: int = 6
    bins: int = 256
    penalty: float = 1.0
    least: float = 1.0
    sample: int | None = None
    seed: int = 42
    task_entries: int = 24_000_000

    def fit_and_score(self, train: DataFrame, held_out: DataFrame, keep: list[str]) -> DataFrame:
        """Fit on `train` (label, features), score `held_out`: the columns `keep` and `prob`, the probability of label 1."""
        trees = self.fit(train)
        names = {c: held_out.schema[c].dataType.simpleString() for c in keep}

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts, at, value = sparse(batch)
                prob = trees.score(starts, at, value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(prob)], [*names, "prob"])

        columns = ", ".join(f"{c} {t}" for c, t in names.items())
        return held_out.select(*keep, *entries()).mapInArrow(score, f"{columns}, prob double")

    def fit(self, train: DataFrame) -> Trees:
        size = F.size(F.unwrap_udt("features")["values"]).cast("long")
        rows, filled, width = train.agg(F.count(F.lit(1)), F.sum(size), F.max(vector_size("features"))).first()
        if self.sample is not None and rows > self.sample:
            train = train.where(F.rand(self.seed) < self.sample / rows).limit(self.sample)
        settings = self

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, labels = Held(), [np.zeros(0)]
            for batch in batches:
                held.add(*by_row(*sparse(batch)), sum(map(len, labels)))
                labels.append(batch.column("label").to_numpy().astype(np.float64))
            label = np.concatenate(labels)
            trees = boosted(held.binned(len(label), settings.bins).search, label, settings)
            out = io.BytesIO()
            np.savez(out, *trees.arrays())
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()])], ["trees"])

        given = train.select(F.col("label").cast("double").alias("label"), *entries())
        parts = -(-(filled or 0) // self.task_entries)
        if parts > 1:
            with FAR:
                return self.fit_far(given, parts)
        # no more than `task_entries` entries meet in this task
        found = given.repartition(1).mapInArrow(grow, "trees binary").first()
        if found is None:  # no row to fit on: the optimiser left the task out
            return grown(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), width or 0, np.zeros(0), settings)
        stored = np.load(io.BytesIO(bytes(found["trees"])))
        return Trees(*(stored[k] for k in stored.files))

    def fit_far(self, given: DataFrame, parts: int) -> Trees:
        """The same trees from features in some `parts` tasks."""
        bins, keys = self.bins, KEYS * parts
        dealt = given.mapInArrow(partial(deal, keys), DEALT).repartition(parts, "key").sortWithinPartitions("task", "batch")
        kept = dealt.mapInArrow(partial(gather, keys, bins), KEPT).persist(StorageLevel.MEMORY_AND_DISK)
        context = given.sparkSession.sparkContext
        try:
            label = np.frombuffer(kept.where("feature = -1").first()["code"])
            round_of: list = [None, None]

            def search(place: np.ndarray, g: np.ndarray, h: np.ndarray, limits: Limits, least_gain: float) -> tuple[np.ndarray, ...]:
                if round_of[0] is not g:
                    if round_of[1] is not None:
                        round_of[1].unpersist()
                    round_of[:] = g, context.broadcast((g, h))
                sent, places = round_of[1], context.broadcast(place.astype(np.uint16))

                def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    features = Features.kept(batches, bins)
                    if features is not None:
                        place = places.value.astype(np.int64)
                        best = features.best(place, *sent.value, limits)
                        lefts = [features.lefts(place, best.feature[k] >= 0, best.feature[k], best.code[k], np.full(len(limits.g), k == 1)) for k in (0, 1)]
                        cut = np.stack([features.cuts(best.feature[k] >= 0, best.feature[k], best.code[k]) for k in (0, 1)])
                        parts = [best.gain, best.feature.astype(float), cut, np.packbits(np.stack(lefts), axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in parts], ["gain", "feature", "cut", "lefts"])

                found = kept.where("feature >= 0").mapInArrow(look, "gain binary, feature binary, cut binary, lefts binary").collect()
                places.unpersist()
                n = len(limits.g)
                best, owner = Best.none(n), np.zeros((2, n), np.int64)
                cut = np.zeros((2, n))
                for i, one in enumerate(found):
                    gain, feature, its_cut = (np.frombuffer(one[c]).reshape(2, n) for c in ("gain", "feature", "cut"))
                    better = (gain > best.gain) | ((gain == best.gain) & (gain > 0) & (feature < best.feature))
                    best.gain[better], best.feature[better], cut[better], owner[better] = gain[better], feature[better], its_cut[better], i
                split, side = best.chosen(least_gain)
                every = np.arange(n)
                lefts = [np.frombuffer(one["lefts"], np.uint8).reshape(2, -1) for one in found]
                left = np.zeros(len(place), bool)
                for i, k in {(owner[side[j], j], side[j]) for j in np.flatnonzero(split)}:
                    its = np.append(split & (side == k) & (owner[side, every] == i), False)[place]
                    left[its] = np.unpackbits(lefts[i][k], count=len(place)).astype(bool)[its]
                return split, best.feature[side, every], cut[side, every], side == 1, left

            return boosted(search, label, self)
        finally:
            kept.unpersist()


def entries() -> tuple[Column, Column]:
    """The places and values of a vector column named features."""
    unwrapped = F.unwrap_udt("features")
    return F.coalesce(unwrapped["indices"], F.sequence(F.lit(0), F.size(unwrapped["values"]) - 1)).alias("at"), unwrapped["values"].alias("value")


def sparse(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's entries begin, their places and their values."""
    at, value = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows["at"], rows["value"]))
    starts = np.append(0, np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    return starts, at.flatten().to_numpy(), value.flatten().to_numpy(zero_copy_only=False)


@dataclass
class Trees:
    """All trees as arrays by (tree, node); the children of node k are 2 k + 1 and 2 k + 2. A leaf has feature -1."""

    base: np.ndarray
    feature: np.ndarray
    cut: np.ndarray  # entries up to it go left
    absent_left: np.ndarray
    leaf: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.base, self.feature, self.cut, self.absent_left, self.leaf]

    def score(self, starts: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row, a thousand rows at a time."""
        used, place = np.unique(np.append(self.feature.ravel(), -1), return_inverse=True)
        place = place[:-1].reshape(self.feature.shape)
        column = np.clip(np.searchsorted(used, at), 0, len(used) - 1)
        known = (used[column] == at) & (value != 0)
        out = np.zeros(len(starts) - 1)
        for a in range(0, len(out), 1000):
            b = min(a + 1000, len(out))
            span = slice(starts[a], starts[b])
            row = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))[known[span]]
            dense = np.full((b - a, len(used)), np.nan)
            dense[row, column[span][known[span]]] = value[span][known[span]]
            margin = np.full(b - a, self.base[0])
            every = np.arange(b - a)
            for t in range(len(self.feature)):
                node = np.zeros(b - a, np.int64)
                while True:
                    inner = self.feature[t, node] >= 0
                    if not inner.any():
                        break
                    x = dense[every, place[t, node]]
                    left = np.where(np.isnan(x), self.absent_left[t, node], x <= self.cut[t, node])
                    node = np.where(inner, 2 * node + 2 - left, node)
                margin += self.leaf[t, node]
            out[a:b] = 1 / (1 + np.exp(-margin))
        return out


def deal(keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of rows the entries of each key's features, and the labels under a key of their own."""
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        row, at, value = by_row(*sparse(batch))
        parts = [[x.tobytes() for x in (row[mine], at[mine].astype(np.int32), value[mine])] for mine in (at % keys == k for k in range(keys))]
        parts.append([b"", b"", batch.column("label").to_numpy().astype(np.float64).tobytes()])
        numbers = [pa.array(np.full(keys + 1, x), pa.int32()) for x in (task, i, batch.num_rows)]
        binaries = [pa.array(x, pa.binary()) for x in zip(*parts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(keys + 1), pa.int32()), *numbers, *binaries], [x.split()[0] for x in DEALT.split(", ")])


def gather(keys: int, bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The binned features of some keys from the batches in their order; all labels as feature -1."""
    held, before, labels = Held(), {}, []
    for batch in batches:
        for x in batch.to_pylist():
            row, at, value = (np.frombuffer(x[c], t) for c, t in (("row", np.int32), ("at", np.int32), ("value", np.float64)))
            if x["key"] == keys:
                labels.append(value)
            else:
                held.add(row, at, value, before.get(x["key"], 0))
                before[x["key"]] = before.get(x["key"], 0) + x["rows"]
    names = [x.split()[0] for x in KEPT.split(", ")]

    def record(feature: int, rows: int, dense: bool, *arrays: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([feature], pa.int32()), pa.array([rows], pa.int64()), pa.array([dense]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
        return pa.RecordBatch.from_arrays(columns, names)

    if labels:
        label = np.concatenate(labels)
        yield record(-1, len(label), False, np.zeros(0), label, np.zeros(0))
    if before:
        rows = next(iter(before.values()))
        features = held.binned(rows, bins)
        for f, codes in features.dense.items():
            yield record(f, rows, True, np.zeros(0), codes, features.upper[f])
        for i, f in enumerate(features.listed):
            mine = slice(features.begin[i], features.begin[i + 1])
            yield record(int(f), rows, False, features.row[mine], features.code[mine] - np.int32(i * features.slots), features.upper[f])


def by_row(starts: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each entry that is not zero."""
    row, kept = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts)), value != 0
    return row[kept], at[kept], value[kept]


def binned(at: np.ndarray, value: np.ndarray, width: int, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each entry, counted through all features, the first bin of each feature, the upper end of each bin).

    A feature has a bin for each of its values, or, if these are more than `bins`, cuts at its quantiles.
    """
    order = np.argsort(at, kind="stable")
    begins = np.searchsorted(at[order], np.arange(width + 1))
    ends, first, code = [], np.zeros(width + 1, np.int64), np.zeros(len(at), np.int64)
    for f in range(width):
        here = order[begins[f] : begins[f + 1]]
        values = np.sort(value[here])
        uppers = np.unique(values)
        if len(uppers) > bins:
            uppers = np.unique(values[np.ceil(np.arange(1, bins + 1) * len(here) / bins).astype(np.int64) - 1])
        code[here] = first[f] + np.searchsorted(uppers, value[here])
        first[f + 1] = first[f] + len(uppers)
        ends.append(uppers)
    return code, first, np.concatenate(ends) if ends else np.zeros(0)


@dataclass
class Held:
    """Entries as they come, by blocks of features."""

    blocks: dict[int, list[tuple[np.ndarray, ...]]] = field(default_factory=dict)

    def add(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, before: int) -> None:
        """Entries of further rows, of which `before` came earlier."""
        block = (at // BLOCK).astype(np.uint16)
        order = np.argsort(block, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(block)))
        for b in np.flatnonzero(np.diff(ends)):
            here = order[ends[b] : ends[b + 1]]
            parts = ((row[here] + before).astype(np.int32), (at[here] % BLOCK).astype(np.uint16), value[here])
            self.blocks.setdefault(int(b), []).append(parts)

    def binned(self, rows: int, bins: int) -> Features:
        """The binned features; what is held goes as they come."""
        out = Features(rows, bins)
        for b in sorted(self.blocks):
            row, at, value = (np.concatenate(x) for x in zip(*self.blocks.pop(b), strict=True))
            code, first, upper = binned(at, value, BLOCK, bins)
            order = np.argsort(at, kind="stable")
            row, code, ends = row[order], code[order], np.searchsorted(at[order], np.arange(BLOCK + 1))
            for f in range(BLOCK):
                mine = slice(ends[f], ends[f + 1])
                if ends[f] < ends[f + 1]:
                    out.add(b * BLOCK + f, row[mine], code[mine] - first[f], upper[first[f] : first[f + 1]])
        return out.ready()


class Features:
    """Binned features. One that most rows have is an array of all rows' bins; the others are lists of rows and bins, one after another."""

    def __init__(self, rows: int, bins: int) -> None:
        self.rows, self.bins, self.kind = rows, bins, np.uint16 if bins < 65536 else np.int64
        self.upper: dict[int, np.ndarray] = {}
        self.dense: dict[int, np.ndarray] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, feature: int, row: np.ndarray, code: np.ndarray, upper: np.ndarray) -> None:
        self.upper[feature] = upper
        if 2 * len(row) > self.rows:
            self.dense[feature] = np.full(self.rows, self.bins, self.kind)
            self.dense[feature][row] = code
        else:
            self.lists[feature] = row, code.astype(np.int32)

    def ready(self) -> Features:
        self.listed = np.array(sorted(self.lists), np.int64)
        self.slots = max((len(self.upper[f]) for f in self.listed), default=1)
        self.begin = np.append(0, np.cumsum([len(self.lists[f][0]) for f in self.listed])).astype(np.int64)
        self.row = np.empty(self.begin[-1], np.int32)
        self.code = np.empty(self.begin[-1], np.int32)  # counted through all listed features, `slots` each
        for i, f in enumerate(self.listed):
            row, code = self.lists.pop(f)
            self.row[self.begin[i] : self.begin[i + 1]] = row
            self.code[self.begin[i] : self.begin[i + 1]] = code + i * self.slots
        return self

    def best(self, place: np.ndarray, g: np.ndarray, h: np.ndarray, limits: Limits) -> Best:
        """The best split of each node. `place` is the row's node, or the number of nodes for rows that have come to a leaf."""
        n, found = len(limits.g), Best.none(len(limits.g))
        for some in chunked(sorted(self.dense), max(1, CELLS // (n * (self.bins + 1)))):
            sums = np.empty((2, n, len(some), self.bins + 1))
            base = place * (self.bins + 1)
            for i, f in enumerate(some):
                key = base + self.dense[f]
                for x, out in zip((g, h), sums, strict=True):
                    out[:, i] = np.bincount(key, x, minlength=(n + 1) * (self.bins + 1))[: n * (self.bins + 1)].reshape(n, -1)
            found.look(sums[0, :, :, :-1], sums[1, :, :, :-1], np.array(some), limits)
        a = 0
        while a < len(self.listed):
            b = a + max(1, CELLS // (n * self.slots))
            b = max(a + 1, min(b, int(np.searchsorted(self.begin, self.begin[a] + ENTRIES, "right")) - 1, len(self.listed)))
            mine, wide = slice(self.begin[a], self.begin[b]), (b - a) * self.slots
            row = self.row[mine].astype(np.int64)
            key = place.take(row)
            key *= wide
            key += self.code[mine]
            key -= a * self.slots
            sums = [np.bincount(key, x.take(row), minlength=(n + 1) * wide)[: n * wide].reshape(n, b - a, self.slots) for x in (g, h)]
            found.look(*sums, self.listed[a:b], limits)
            a = b
        return found

    def search(self, place: np.ndarray, g: np.ndarray, h: np.ndarray, limits: Limits, least_gain: float) -> tuple[np.ndarray, ...]:
        """(whether each node splits, feature, cut, whether absent entries go left) and whether each row of those nodes goes left."""
        best = self.best(place, g, h, limits)
        split, side = best.chosen(least_gain)
        feature, code = (x[side, np.arange(len(side))] for x in (best.feature, best.code))
        return split, feature, self.cuts(split, feature, code), side == 1, self.lefts(place, split, feature, code, side == 1)

    def cuts(self, split: np.ndarray, feature: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.array([self.upper[f][c] if s else 0.0 for s, f, c in zip(split.tolist(), feature.tolist(), code.tolist(), strict=True)])

    def lefts(self, place: np.ndarray, split: np.ndarray, feature: np.ndarray, code: np.ndarray, absent_left: np.ndarray) -> np.ndarray:
        """Whether each row of a node that splits goes left: those with an entry of its feature by their bin, the others as told."""
        order = np.argsort(place.astype(np.uint16), kind="stable")
        ends, left = np.searchsorted(place[order], np.arange(len(split) + 1)), np.zeros(len(place), bool)
        for k in np.flatnonzero(split):
            f, rows = int(feature[k]), order[ends[k] : ends[k + 1]]
            if f in self.dense:
                codes = self.dense[f][rows]
                left[rows] = np.where(codes == self.bins, absent_left[k], codes <= code[k])
                continue
            left[rows] = absent_left[k]
            i = int(np.searchsorted(self.listed, f))
            mine = slice(self.begin[i], self.begin[i + 1])
            row = self.row[mine]
            inside = place[row] == k
            left[row[inside]] = self.code[mine][inside] - i * self.slots <= code[k]
        return left

    @classmethod
    def kept(cls, batches: Iterator[pa.RecordBatch], bins: int) -> Features | None:
        """From records of `gather`."""
        out = None
        for batch in batches:
            for f, rows, dense, *arrays in zip(*batch.to_pydict().values(), strict=True):
                out = out or cls(rows, bins)
                out.upper[f] = np.frombuffer(arrays[2])
                if dense:
                    out.dense[f] = np.frombuffer(arrays[1], out.kind)
                else:
                    out.lists[f] = np.frombuffer(arrays[0], np.int32), np.frombuffer(arrays[1], np.int32)
        return out and out.ready()


def chunked(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


@dataclass
class Limits:
    """The sums of each node, the penalty and the least curvature, all in units."""

    g: np.ndarray
    h: np.ndarray
    penalty: float
    least: float


@dataclass
class Best:
    """The best split of each node with absent entries right, and left: (gain, feature, bin), each by (side, node)."""

    gain: np.ndarray
    feature: np.ndarray
    code: np.ndarray

    @classmethod
    def none(cls, n: int) -> Best:
        return cls(np.full((2, n), -1.0), np.full((2, n), -1), np.zeros((2, n), np.int64))

    def look(self, g: np.ndarray, h: np.ndarray, features: np.ndarray, limits: Limits) -> None:
        """At histograms by (node, feature, bin) of features in rising order."""
        n, _, slots = g.shape
        filled = np.count_nonzero(h.reshape(n, -1), axis=1) if h.flags.c_contiguous else np.count_nonzero(h, axis=(1, 2))
        thin = 3 * filled < h[0].size
        for nodes in (np.flatnonzero(~thin), np.flatnonzero(thin)):
            if not len(nodes):
                continue
            gw, hw = limits.g[nodes], limits.h[nodes]
            x, y = (g, h) if len(nodes) == n else (g[nodes], h[nodes])
            if not thin[nodes[0]]:
                a, b = np.cumsum(x, axis=2), np.cumsum(y, axis=2)
                ga, ha = gw[:, None] - a[:, :, -1], hw[:, None] - b[:, :, -1]
                whole = (gw[:, None, None], hw[:, None, None])
                ga, ha = ga[:, :, None], ha[:, :, None]
            else:  # only cells with entries
                cell = np.flatnonzero(y)
                if not len(cell):
                    continue
                group = cell // slots
                first = np.append(True, group[1:] != group[:-1])
                begin, of_group = np.flatnonzero(first), np.cumsum(first) - 1
                node = group // len(features)
                ends = np.append(begin[1:], len(cell)) - 1
                of_node = node[begin]
                whole = (gw[node], hw[node])
                sides = []
                for v, w in ((x, gw), (y, hw)):
                    running = np.cumsum(v.ravel()[cell])
                    before = np.append(0.0, running[:-1])[begin]
                    sides.append((running - before[of_group], (w[of_node] - (running[ends] - before))[of_group]))
                (a, ga), (b, ha) = sides
                bounds = np.searchsorted(node, np.arange(len(nodes) + 1))
            for side in (0, 1):
                if side:
                    if not np.any(ha):
                        continue  # no entry is absent, so both sides are the same
                    a, b = a + ga, b + ha
                gain = gains(a, b, *whole, limits)
                if not thin[nodes[0]]:
                    flat = gain.reshape(len(nodes), -1)
                    at = flat.argmax(axis=1)
                    value, at_feature, code = flat[np.arange(len(nodes)), at], at // slots, at % slots
                    there = nodes
                else:
                    at = np.array([c + gain[c:d].argmax() for c, d in zip(bounds[:-1], bounds[1:], strict=True) if d > c])
                    there = nodes[bounds[1:] > bounds[:-1]]
                    value, at_feature, code = gain[at], group[at] % len(features), cell[at] % slots
                feature = features[at_feature]
                old, of = self.gain[side, there], self.feature[side, there]
                better = (value > old) | ((value == old) & (value > 0) & (feature < of))
                won = there[better]
                self.gain[side, won], self.feature[side, won], self.code[side, won] = value[better], feature[better], code[better]

    def chosen(self, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether each node splits, and the side of absent entries: right unless left is better."""
        best = np.maximum(self.gain[0], least_gain)
        side = (self.gain[1] > best * (1 + 1e-9)).astype(np.int64)
        return np.where(side == 1, self.gain[1], best) > least_gain, side


def gains(a: np.ndarray, b: np.ndarray, gw: np.ndarray, hw: np.ndarray, limits: Limits) -> np.ndarray:
    """What splits with the sums a, b on their left gain; -1 where a side has too little curvature."""
    gain = a * a
    gain /= b + limits.penalty
    rest = gw - a
    rest *= rest
    other = hw - b
    few = other < limits.least
    few |= b < limits.least
    other += limits.penalty
    rest /= other
    gain += rest
    gain -= gw * gw / (hw + limits.penalty)
    gain[few] = -1
    return gain


def grown(starts: np.ndarray, at: np.ndarray, value: np.ndarray, width: int, label: np.ndarray, settings: Booster) -> Trees:
    """Trees fitted on rows with 0/1 labels; entries of zero count as absent."""
    held = Held()
    held.add(*by_row(starts, at, value), 0)
    return boosted(held.binned(len(label), settings.bins).search, label, settings)


def boosted(search: Search, label: np.ndarray, settings: Booster) -> Trees:
    """Trees by what `search` finds for each level."""
    share = np.clip(label.mean() if len(label) else 0.5, 1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    nodes = (2 << settings.depth) - 1
    trees = Trees(np.array([base]), *(np.zeros((settings.rounds, nodes), t) for t in (np.int64, np.float64, bool, np.float64)))
    trees.feature[:] = -1
    margin = np.full(len(label), base)
    unit = 2.0 ** (math.ceil(math.log2(len(label) + 1)) - 51)  # sums over all rows are exact
    for t in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - label) / unit), np.maximum(np.rint(p * (1 - p) / unit), 1.0)
        node = grow_tree(trees, t, g, h, unit, search, settings)
        margin += trees.leaf[t, node]
    return trees


def grow_tree(trees: Trees, t: int, g: np.ndarray, h: np.ndarray, unit: float, search: Search, s: Booster) -> np.ndarray:
    """Fill in tree t from gradients and curvatures, level by level; the leaf of each row."""
    node = np.zeros(len(g), np.int64)
    for level in range(s.depth + 1):
        low = (1 << level) - 1
        active = low + np.flatnonzero(np.bincount(node, minlength=2 * low + 1)[low:])
        n = len(active)
        if not n:
            break
        spot = np.full(2 * low + 1, n)  # rows whose node is above this level have come to a leaf
        spot[active] = np.arange(n)
        place = spot[node]
        sums = [np.bincount(place, x, minlength=n + 1)[:n] for x in (g, h)]
        trees.leaf[t, active] = -s.rate * (sums[0] * unit) / (sums[1] * unit + s.penalty)
        if level == s.depth:
            break
        split, feature, cut, left_too, left = search(place, g, h, Limits(*sums, s.penalty / unit, s.least / unit), 1e-10 / unit)
        if not split.any():
            break
        trees.feature[t, active[split]] = feature[split]
        trees.cut[t, active[split]] = cut[split]
        trees.absent_left[t, active[split]] = left_too[split]
        moves = np.append(split, False)[place]
        node[moves] = 2 * node[moves] + 2 - left[moves]
        # a row that stays has a smaller number than any node of the next level
    return node
