"""N-gram Jaccard join by T-occurrence search.

A text is the set of its shingles of five lower-cased words. Two sets link when 100 * common >= 80 * union. The join runs on
classes, the sets that differ; texts with equal sets meet in their class without being paired.

1. A class of s shingles needs T = ceil(0.8 s) of its shingles in the other set, so at most s - T may lie in no other
   class. The first shingles of each class by hash (half more than s - T + 1) are looked up among the first ones of all
   classes; where too few of them are met, no partner exists (`further` says why). Most of a corpus ends here, and only
   hashes have been shuffled.
2. The rest, with whole sets, takes part in the search. Its shingles are ordered from rare to frequent (frequent ones by a
   bounded table of counts; any order is exact), and any two linked classes share one of their first s - T + 1 in it.
3. Within the inverted list of each such shingle, every class is first tried against one class of the list only. Once these
   links are joined to components, lists whose classes are all in one component hold nothing new. After a few such rounds,
   all pairs across components are tried in the lists that are left. So groups of thousands of near copies cost about a
   trial a member, and no link between components is missed.
4. A trial is a T-occurrence search: for a query class and the classes it meets, the inverted lists of the query's shingles
   are split by length, the short ones merged by a heap, and the long ones probed by binary search (DivideSkip).
"""

from __future__ import annotations

import heapq
import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.llm.components import components
from mailsift.session import shared_folder, write_and_read

SIZE = 5
#: Links need this many hundredths of the union in common.
PERCENT = 80
#: Frequent shingles that are ordered by their count; the rest come first, by hash.
FREQUENT = 1 << 17
#: Postings that a task gathers before it combines and emits them.
GATHERED = 400_000
#: Classes that one search takes beside its query.
MEMBERS = 500
#: Ids of documents that are sent to all tasks, at most.
SENT = 4_000_000
#: Rounds in which lists are tried against one of their classes, before all pairs across components.
STARS = 2


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """The least number of common shingles that a set of n needs, with any partner."""
    return -(-n * percent // 100)


def linked(common_: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common_ >= percent * (a + b - common_)


def shingle_sets(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, where each set begins, and a hash of each set."""
    data, offsets = common.text_bytes(texts)
    words = common.words(data, offsets)
    n = len(offsets) - 1
    hashes = words.hashed(common.LOWER[data])
    full = words.doc[SIZE - 1 :] == words.doc[: max(0, len(words.doc) - SIZE + 1)]
    values, docs = [common.windows(hashes, SIZE)[full]], [words.doc[SIZE - 1 :][full]]
    first = np.cumsum(words.per_doc) - words.per_doc
    for k in range(1, SIZE):  # a shorter text is one shingle
        short = np.flatnonzero(words.per_doc == k)
        whole = hashes[first[short]]
        for i in range(1, k):
            whole = whole * np.uint64(common.BASE) + hashes[first[short] + i]
        values.append(common.mixed(whole + np.uint64(k)))
        docs.append(short)
    values, docs = np.concatenate(values).view(np.int64), np.concatenate(docs)
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    starts = np.searchsorted(docs, np.arange(n + 1))
    turned = common.mixed(values.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(turned, out=total[1:])
    ids = common.mixed(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(np.uint64))
    return values, starts, ids.view(np.int64)


def further(spare, percent: int):
    """How many shingles a set that may miss `spare` looks up beyond spare + 1. A set with a partner meets 1 more than that.

    Sets of n = c + a and m = c + b with c in common look up p(n) and p(m) shingles in one order, p = spare + 1 + spare // 2.
    At least p(n) - a of the first and p(m) - b of the second are common, and each time they are the first of the common ones,
    so the smaller number is met. p(n) - a >= 1 + spare(n) // 2 as a <= spare(n). p(m) - b is as large if
    spare(n) // 2 - spare(m) // 2 <= spare(m) - b. With the share r = percent / 100, spare(s) = floor((1 - r) s), and a link
    means (1 - r) c >= r (a + b). So spare(m) - b = floor((1 - r) c - r b) >= floor(r a) >= 0. If a <= b, spare(n) <= spare(m).
    If a > b, the left side is at most ceil(ceil((1 - r) a) / 2), which for r >= 1/2 is at most floor(r a) from a = 2 on; for
    a = 1 and b = 0, spare(n) <= spare(m) + 1, and the left side is 0 if spare(m) = 0 and at most 1 otherwise. A set that
    looks up all its shingles misses no common one. Half of spare rounded up would lose 4 against 5 shingles. For r < 1/2
    nothing is added: a set with a partner meets 1.
    """
    return spare // 2 if percent >= 50 else spare * 0


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set are looked up first: more than may be missing by half, but never more than there are."""
    spare = n - needed(n, percent)
    return np.minimum(n, spare + 1 + further(spare, percent))


def posted(percent: int):
    """For a task: the postings of its classes, as rows (class, shingle, n).

    With n = 0 it is a posting whose shingle is in one class of this task. A shingle that is in several of them is emitted
    once, with class NULL, and counted for its classes at once: rows with n > 0 have the number of such shingles of a class.
    So a shingle or a copy that is everywhere sends a few rows per task.
    """

    def combined(shingles: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shingle, cls = np.concatenate(shingles), np.concatenate(classes)
        order = np.argsort(shingle)
        shingle, cls = shingle[order], cls[order]
        same = shingle[1:] == shingle[:-1]
        shared = np.append(False, same) | np.append(same, False)
        first = shared & ~np.append(False, same)
        owners, counts = np.unique(cls[shared], return_counts=True)
        own = np.flatnonzero(~shared)
        parts = [(cls[own[a : a + 100_000]], shingle[own[a : a + 100_000]], 0) for a in range(0, len(own), 100_000)]
        for c, s, n in [*parts, (None, shingle[first], 0), (owners, owners, counts)]:
            c = pa.nulls(len(s), pa.int64()) if c is None else pa.array(c)
            yield pa.RecordBatch.from_arrays([c, pa.array(s), pa.array(np.broadcast_to(n, len(s)).astype(np.int64))], ["class", "shingle", "n"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, shingles, classes, held = set(), [], [], 0
        for rows in common.gathered(batches):
            values, starts, ids = shingle_sets(rows["text"])
            n = np.diff(starts)
            new = np.zeros(len(n), bool)
            for k in np.flatnonzero(n).tolist():
                if (c := int(ids[k])) not in seen:
                    seen.add(c)
                    new[k] = True
            take = np.where(new, prefix_sizes(n, percent), 0)
            at = np.repeat(starts[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            shingles.append(values[at])
            classes.append(np.repeat(ids, take))
            held += len(at)
            if held > GATHERED:
                yield from combined(shingles, classes)
                shingles, classes, held, seen = [], [], 0, set()
        if held:
            yield from combined(shingles, classes)

    return common.tidied(post)


def possible(docs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Classes (class, n, doc_id) that may have a partner. A class met in several tasks may be counted more than once, which
    keeps it needlessly at worst."""
    # shuffled once: a window sees all postings of a shingle and leaves each with what it has met
    postings = docs.select("text").mapInArrow(posted(percent), "class long, shingle long, n long").repartition("shingle")
    named, of = F.when(F.col("n") == 0, F.col("class")), Window.partitionBy("shingle")
    # a shingle of several classes: two of them here, or one marked so by its task
    several = (F.min(named).over(of) != F.max(named).over(of)) | (F.count_if(F.col("n") == 0).over(of) > F.count(named).over(of))
    met = F.when(F.col("n") > 0, F.col("n")).otherwise(F.coalesce(several, F.lit(False)).cast("long"))
    counts = postings.select("class", met.alias("k")).groupBy("class").agg(F.sum("k").alias("k"))
    spare = F.col("n") - F.ceil(F.col("n") * percent / 100)
    more = F.floor(spare / 2) if percent >= 50 else F.lit(0)  # as `further`
    taken = F.least(F.col("n"), spare + 1 + more)
    return counts.join(sizes, "class").where(F.col("k") >= taken - spare).select("class", "n", "doc_id")


def chosen(docs: DataFrame, ids: DataFrame, most: int = SENT) -> DataFrame:
    """The rows of `docs` whose doc_id is in `ids`, or null. Up to `most` ids, as counted, go to all tasks, so that no text is shuffled;
    beyond that the texts are."""
    ids = ids.select("doc_id")
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").union(docs.where("doc_id IS NULL"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Store the rows in the shared folder, dealt out and sorted by `key`, which joins and groups by it then need not do again."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = os.path.join(shared_folder(spark), name)
    df.write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows where `bucketed` wants them, so that each task writes one file."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, class) of each row."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            _, starts, ids = shingle_sets(rows["text"])
            yield from pa.table({"doc_id": rows["doc_id"], "n": np.diff(starts), "class": ids}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(common.tidied(classify), "doc_id long, n long, class long")


def whole_sets(docs: DataFrame) -> DataFrame:
    """(class, n, shingles) of each row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            values, starts, ids = shingle_sets(rows["text"])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))
            yield from pa.table({"class": ids, "n": np.diff(starts), "shingles": lists}).to_batches(max_chunksize=200)

    return docs.select("text").mapInArrow(common.tidied(sets), "class long, n long, shingles array<long>")


def frequent(sets: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent shingles and their ranks: what tasks are sent is bounded by it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            often = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[often]), pa.array(counts[often])], ["shingle", "k"])

    counts = sets.select("shingles").mapInArrow(common.tidied(count), "shingle long, k long").groupBy("shingle").agg(F.sum("k").alias("k"))
    top = counts.orderBy(F.desc("k"), "shingle").limit(most).toPandas().sort_values("shingle")
    return top["shingle"].to_numpy(np.int64), top["k"].to_numpy(np.int64)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, class, n, place): the rarest shingles of each class, one more than it may miss, and their places in order."""
    known, counts = frequent(sets)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            values, n = lists.flatten().to_numpy(), batch.column("n").to_numpy()
            rank = np.zeros(len(values), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                rank = np.where(known[place] == values, counts[place], 0)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, rank, doc))
            within = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            kept = within <= np.repeat(n - needed(n, percent), n)
            at = order[kept]
            columns = [pa.array(values[at]), batch.column("class").take(pa.array(doc[at])), pa.array(n[doc[at]]), pa.array(within[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "class", "n", "place"])

    return sets.mapInArrow(common.tidied(take), "shingle long, class long, n long, place long")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Which of `sets` link with the query, by T-occurrence search over inverted lists of their common shingles."""
    out = [False] * len(sets)
    if not sets or not len(query):
        return out
    shingles = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.searchsorted(query, shingles)
    place[place == len(query)] = 0
    hit = query[place] == shingles
    order = np.lexsort((member[hit], place[hit]))
    of, ids = place[hit][order], member[hit][order]
    if not len(of):
        return out
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    lists = sorted((ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(of)], strict=True)), key=len)
    threshold = int(needed(len(query), percent))
    if len(lists) < threshold:
        return out
    # long lists are only probed, for what the short ones have found often enough; there must be fewer than T of them
    typical = len(lists[len(lists) // 2])
    n_long = min(threshold - 1, sum(len(x) > 2 * typical for x in lists)) if len(sets) > 16 else 0
    n_long = max(n_long, min(threshold - 1, int(threshold / (1 + np.log2(1 + len(lists[-1]))))))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    previous, count = -1, 0

    def settle(m: int, found: int) -> None:
        if found + len(long) < threshold:
            return
        for left, x in enumerate(long):
            if found + len(long) - left < threshold:
                return
            at = bisect_left(x, m)
            found += at < len(x) and x[at] == m
        out[m] = linked(int(found), len(query), len(sets[m]), percent)

    for m in heapq.merge(*(x.tolist() for x in short)):
        if m != previous:
            if previous >= 0:
                settle(previous, count)
            previous, count = m, 0
        count += 1
    if previous >= 0:
        settle(previous, count)
    return out


def tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that link. A query with many partners is searched in several groups."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(64)))
    many = pairs.groupBy("a").agg(F.count("*").alias("k"))
    parts = F.least(F.lit(1 << 20), F.ceil(F.col("k") / MEMBERS))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    queries = pairs.select("a", "part").distinct().join(sets.select(F.col("class").alias("a"), "shingles"), "a")
    members = pairs.join(sets.select(F.col("class").alias("b"), "shingles"), "b").select("a", "part", "b", "shingles")
    rows = queries.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles").union(members)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, found, held = None, None, [], []

        def finish() -> pa.RecordBatch:
            good = [b for b, ok in zip(found, divide_skip(query, held, percent), strict=True) if ok]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(good), pa.int64()), pa.array(good, pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("shingles")
            values, starts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().cumsum()
            for i, (a, part, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), strict=True)):
                own = values[starts[i - 1] if i else 0 : starts[i]].copy()
                if b is None:  # nulls come first: a new query
                    if key is not None:
                        yield finish()
                    key, query, found, held = (a, part), own, [], []
                else:
                    found.append(b)
                    held.append(own)
        if key is not None:
            yield finish()

    return rows.mapInArrow(common.tidied(search), "a long, b long")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that have the same components as all links together."""
    # a shingle that one class alone looks up leads nowhere
    posts = dealt(prefixes(sets, percent), "shingle").withColumn("k", F.count("*").over(Window.partitionBy("shingle")))
    posts = bucketed(posts.where("k > 1").drop("k"), "shingle", "jaccard_prefixes")
    # if a shingle is the first in order that both have, neither has more in common than what follows it
    common_ = F.col("n") + F.col("an")
    enough = ((100 + percent) * (F.col("n") - F.col("place")) >= percent * common_) & ((100 + percent) * (F.col("an") - F.col("a_place")) >= percent * common_)
    lists = posts.withColumn("root", F.col("class"))
    links = past = None
    for turn in range(STARS):
        # a list's head is the class with the least before the shingle, so one with few shingles of its own; later, any
        rank = F.col("place") if turn == 0 else F.xxhash64(F.lit(turn), "class")
        heads = lists.groupBy("shingle").agg(
            F.min_by("class", rank).alias("a"), F.min_by("n", rank).alias("an"), F.min_by("place", rank).alias("a_place"), F.min_by("root", rank).alias("a_root"), F.min("root").alias("low"), F.max("root").alias("high")
        )
        pairs = lists.join(heads.where("low <> high"), "shingle").where(F.col("root") != F.col("a_root")).where(enough)
        links, past = trial(pairs.select("a", F.col("class").alias("b")), links, past, sets, percent)
        roots = components(links, f"jaccard-star-{turn}").withColumnRenamed("node", "class")
        if roots.count() <= SENT // 4:  # as counted; beyond that the lists are shuffled
            roots = F.broadcast(roots)
        labelled = posts.join(roots, "class", "left").select("shingle", "class", "n", "place", F.coalesce("root", "class").alias("root"))
        of = Window.partitionBy("shingle")
        several = dealt(labelled, "shingle").withColumn("several", F.min("root").over(of) != F.max("root").over(of))
        lists = bucketed(several.where("several").drop("several"), "shingle", "jaccard_lists")
    other = lists.select("shingle", F.col("class").alias("a"), F.col("n").alias("an"), F.col("place").alias("a_place"), F.col("root").alias("a_root"))
    across = lists.withColumnRenamed("class", "b").join(other, "shingle").where("a < b AND root <> a_root").where(enough)
    return trial(across.select("a", "b"), links, past, sets, percent)[0]


def trial(pairs: DataFrame, links: DataFrame | None, past: DataFrame | None, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links and the tried pairs so far, after these pairs."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if past is not None:
        pairs = pairs.join(past, ["a", "b"], "left_anti")
    pairs = write_and_read(pairs, "jaccard-pairs")
    found = write_and_read(tried(pairs, sets, percent), "jaccard-links")
    return (found, pairs) if links is None else (links.union(found), past.union(pairs))


def near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the smallest doc_id reachable by links.

    Null, empty and blank texts have no shingle, link with nothing and are their own component. Equal texts are in one
    component, also with equal ids. A null doc_id is kept; its component is that of the smallest id it is linked with, or
    null. Other columns of `docs` are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = write_and_read(classed(docs), "jaccard-classes")
    sizes = rows.where("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("doc_id"))
    grouped = sizes.select("class", "doc_id").join(class_roots(docs, sizes, percent), "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.where("doc_id IS NOT NULL OR root <> class").join(smallest, "root").select("class", "component_id")
    out = rows.join(of_class, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def class_roots(docs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(class, root) of the classes with links. `sizes` has (class, n, doc_id), doc_id being that of one of its rows."""
    alive = write_and_read(possible(docs, sizes, percent), "jaccard-possible")
    sets = dealt(whole_sets(chosen(docs, alive.where("doc_id IS NOT NULL"))).where("n > 0"), "class").dropDuplicates(["class"])
    sets = bucketed(sets, "class", "jaccard_sets")
    return components(class_links(sets, percent), "jaccard").withColumnRenamed("node", "class")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of `docs` for each group of near copies: the first by doc_id (a null one last), of equal ids the first by text.

    Rows without a shingle (null, empty and blank texts) are in no group and all stay, also if they repeat. Ids decide nothing
    else: a row whose id repeats goes only if its own text is in a group of which another row stays.
    """
    # each row carries a number of its own, as rows may be alike in id and text; it is stored, so that it stays what it is
    marked = write_and_read(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-rows")
    numbered = marked.select(F.col("__row").alias("doc_id"), "text")
    own = write_and_read(classed(numbered).where("n > 0"), "jaccard-classes")
    sizes = own.groupBy("class", "n").agg(F.min("doc_id").alias("doc_id"))
    roots = class_roots(numbered, sizes, percent)
    rows = own.select(F.col("doc_id").alias("__row"), "class").join(roots, "class", "left").select("__row", F.coalesce("root", "class").alias("root"))
    rows = rows.join(marked.select("__row", "doc_id", F.xxhash64("text").alias("h")), "__row")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "__row")).alias("first")).select(F.col("first.__row").alias("__row"))
    gone = write_and_read(rows.select("__row").join(first, "__row", "left_anti"), "jaccard-gone")
    if gone.count() <= SENT:
        gone = F.broadcast(gone)
    return marked.join(gone, "__row", "left_anti").drop("__row")
