"""Ranked lexical search: exact largest inner products by best-first search of sparse ball trees.

A document is a sparse vector of whole numbers, one for each term that some query has, and a query is the set of its terms, so
that a score is an inner product. Documents are put into ball trees, a block of bounded size at a time: a node has the
mean of its documents and the largest distance of one of them from it. With S the terms that occur below a node, no document
there scores more than q.mean + sqrt(|q and S|) * radius. Nodes are taken in order of that bound until it is below the worst
score kept, so whole subtrees are skipped; at the leaves, scores are added up in 64-bit whole numbers. Bounds are rounded up
by more than doubles can lose, so that none is too small.

Queries are taken in blocks whose terms have a bounded number; for each block all documents are read. A task returns its best
documents of each query, and these are ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.session import write_and_read

#: Results of a query.
TOP = 50
#: Terms of the queries that are searched at a time, about; what tasks are sent is bounded by it.
TERMS = 1 << 20
#: Documents of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Entries of documents of a tree: with long documents it has fewer of them.
ENTRIES = 2_000_000
#: Bounds are larger by this part than computed, and by one. Sums of some thousand doubles lose less than 1e-12.
SLACK = 1e-9

TERM = np.zeros(256, np.uint8)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = 1


def terms_of(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of the texts, and how many terms each text has. A null text has none."""
    data, offsets = common.text_bytes(texts)
    found = common.runs(TERM[data], offsets)
    return found.hashed(common.LOWER[data]), found.per_doc


def items_of(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item_id, terms): the distinct term hashes of each query. Rows that share an id are one query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            hashes, n = terms_of(rows["text"])
            each = [np.unique(x.view(np.int64)) for x in np.split(hashes, np.cumsum(n)[:-1])]
            yield from pa.table({"item_id": rows["item_id"], "terms": pa.array(each, pa.list_(pa.int64()))}).to_batches(max_chunksize=1000)

    kind = items.schema[item_id].dataType.simpleString()
    read_ = items.select(F.col(item_id).alias("item_id"), "text").mapInArrow(read, f"item_id {kind}, terms array<long>")
    return read_.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, term, tf) of each row: all its terms counted, and those of the vocabulary as their places in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            hashes, n = terms_of(rows["text"])
            doc, value = np.repeat(np.arange(len(n)), n), hashes.view(np.int64)
            place = np.minimum(np.searchsorted(vocabulary, value), max(0, len(vocabulary) - 1))
            known = vocabulary[place] == value if len(vocabulary) else np.zeros(len(value), bool)
            cells, tf = np.unique(doc[known] * (len(vocabulary) + 1) + place[known], return_counts=True)
            doc, place = np.divmod(cells, len(vocabulary) + 1)
            starts = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (place, tf)]
            yield from pa.table([rows["doc_id"], pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "term", "tf"]).to_batches(max_chunksize=1000)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, term array<int>, tf array<int>")


def document_counts(found: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary. A task sends one row for each term it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("term").flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(width, np.int64)
    for row in found.select("term").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


@dataclass
class Sparse:
    """Rows of whole numbers in compressed form."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def taken(self, rows: np.ndarray) -> Sparse:
        n = self.starts[rows + 1] - self.starts[rows]
        starts = np.append(0, np.cumsum(n))
        at = np.repeat(self.starts[rows] - starts[:-1], n) + np.arange(starts[-1])
        return Sparse(starts, self.terms[at], self.values[at])

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product of each row with a dense vector."""
        total = np.append(0, np.cumsum(self.values * dense[self.terms]))
        return total[self.starts[1:]] - total[self.starts[:-1]]


class Ball:
    """A node: the mean of its rows, their largest distance from it, and its halves or its own rows."""

    __slots__ = ("terms", "mean", "radius", "halves", "rows", "ids")

    def __init__(self, rows: Sparse, ids: np.ndarray, width: int):
        mean = np.bincount(rows.terms, rows.values, minlength=width) / max(1, len(ids))
        present = np.bincount(rows.terms, minlength=width) > 0
        self.terms = np.flatnonzero(present)
        self.mean = mean[self.terms]
        self.halves, self.rows, self.ids = None, rows, ids
        norms = np.add.reduceat(np.append(rows.values.astype(np.float64) ** 2, 0.0), rows.starts[:-1]) * (np.diff(rows.starts) > 0)
        spread = np.maximum(0, norms - 2 * rows.times(mean) + self.mean @ self.mean)
        # squares are subtracted, so what rounding can hide is added before the root
        self.radius = float(np.sqrt(spread.max(initial=0) + 1e-9 * (norms.max(initial=0) + self.mean @ self.mean)))
        if len(ids) <= LEAF or spread.max(initial=0) <= 0:
            return

        def far(row: int) -> tuple[np.ndarray, np.ndarray]:
            a, b = rows.starts[row], rows.starts[row + 1]
            point = np.zeros(width)
            point[rows.terms[a:b]] = rows.values[a:b]
            return point, norms + norms[row] - 2 * rows.times(point)

        _, from_first = far(int(spread.argmax()))  # the outermost row and the row farthest from it become the poles
        _, from_second = far(int(from_first.argmax()))
        nearer = from_first - from_second
        order = np.argsort(nearer, kind="stable")
        cut = int(np.clip(np.searchsorted(nearer[order], 0), len(ids) // 8, len(ids) - len(ids) // 8))  # no sliver, so the depth is bounded
        self.halves = [Ball(rows.taken(part), ids[part], width) for part in (order[:cut], order[cut:])]
        self.rows = self.ids = None

    def bound(self, wanted: np.ndarray) -> float:
        """No row below scores more for the query, given as a mask of terms."""
        shared = wanted[self.terms]
        return (self.mean[shared].sum() + np.sqrt(np.count_nonzero(shared)) * self.radius) * (1 + SLACK) + 1


class Best:
    """The best documents of a query so far: higher scores, of equal ones smaller ids, a null id last."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    @property
    def least(self) -> int:
        """Only scores of at least this can get in."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def search(self, tree: Ball, query: np.ndarray, wanted: np.ndarray) -> int:
        """Take in the documents of the tree, best nodes first; the number of leaves looked at."""
        waiting, leaves, tick = [(-tree.bound(wanted), 0, tree)], 0, 1
        while waiting:
            bound, _, node = heapq.heappop(waiting)
            if -bound < self.least:
                break
            if node.halves:
                for half in node.halves:
                    heapq.heappush(waiting, (-half.bound(wanted), tick, half))
                    tick += 1
                continue
            leaves += 1
            scores = np.append(0, np.cumsum(np.where(wanted[node.rows.terms], node.rows.values, 0)))
            scores = scores[node.rows.starts[1:]] - scores[node.rows.starts[:-1]]
            for k in np.flatnonzero(scores >= self.least).tolist():
                entry = (int(scores[k]), *node.ids[k])
                if len(self.heap) < self.top:
                    heapq.heappush(self.heap, entry)
                elif entry > self.heap[0]:
                    heapq.heapreplace(self.heap, entry)
        return leaves


def searched(found: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, doc_id, score): the best `top` documents of each task for each query."""
    width = len(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries]
        held, rows, entries = [], 0, 0

        def build() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            n, lists = table["n"].to_numpy(), table["term"].combine_chunks()
            starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            term, tf = lists.flatten().to_numpy().astype(np.int64), table["tf"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            values = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(starts))))
            # of equal scores the smaller id is greater in the heap; without an id a document comes after those with one
            ids = np.empty(len(n), object)
            ids[:] = [(x is not None, 0 if x is None else -x) for x in table["doc_id"].to_pylist()]
            full = np.flatnonzero(np.diff(starts) > 0)
            if not len(full):
                return
            tree = Ball(Sparse(starts, term, values).taken(full), ids[full], width)
            wanted = np.zeros(width, bool)
            for k, query in enumerate(queries):
                wanted[query] = True
                best[k].search(tree, query, wanted)
                wanted[query] = False

        for batch in batches:
            for a in range(0, len(batch), LEAF):
                part = batch.slice(a, LEAF)
                held.append(part)
                rows, entries = rows + len(part), entries + len(part.column("term").flatten())
                if rows >= BLOCK or entries >= ENTRIES:
                    build()
                    held, rows, entries = [], 0, 0
        if held:
            build()
        out = [(k, -i if known else None, score) for k, b in enumerate(best) for score, known, i in b.heap]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query", "doc_id", "score"])

    return found.where("size(term) > 0").select(F.col("doc_id").cast("long"), "n", "term", "tf").mapInArrow(search, "query long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest-scoring rows of `docs` (doc_id, text) for each of `items` (item_id, text).

    A null text has no terms, and a query without terms no results. Each row of `docs` is a document, also if it repeats an id;
    documents without an id come last among equal scores. Items that share an id (or have none) are one query. Terms are
    told apart by a hash of 64 bits. `doc_id` is a whole number. Other columns are not read.
    """
    queries = write_and_read(items_of(items), "lexical-items")
    blocks = -(-(queries.agg(F.sum(F.size("terms"))).first()[0] or 0) // most)
    kind = queries.schema["item_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        part = queries.where(F.size("terms") > 0).where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == block).collect()  # about `most` terms
        if not part:
            continue
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in part]))
        wanted = [np.searchsorted(vocabulary, np.array(r["terms"], np.int64)) for r in part]
        found = write_and_read(vectors(docs, vocabulary), "lexical-vectors")
        n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        df = document_counts(found, len(vocabulary))
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        results = searched(found, wanted, weights, n_docs, n_terms, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        results = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(k, r["item_id"]) for k, r in enumerate(part)], f"query long, item_id {kind}")
        results = results.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = results if out is None else out.union(results)
    return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
