"""Spelling variants: words one edit apart, by search schemes over a bidirectional FM-index.

Words one edit apart agree in one half of the searched word. So the vocabulary is dealt out twice, by first halves and by last
halves, and only words that share one are looked at together. A task indexes the words dealt to it, some thousand at a time: the
text of all words with a delimiter around each, its suffix ranks and those of the reversed text. A word is searched by two
schemes. The first matches its first half exactly, from the middle to the front, and extends across the last half with one error;
the second matches the last half from the middle to the end and extends to the front. Both keep an interval of suffix ranks in
either direction, so that extending can turn around. All words of a block advance together as arrays of intervals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm import common
from mailsift.session import write_and_read

#: Code points of the shortest word, and occurrences of the rarest.
LENGTH, COUNT = 6, 5
#: One occurrence in so many loses a letter, by a checksum of document and word.
EVERY = 199
#: A form is at least so many times as frequent.
TIMES = 5
#: Words that a task indexes at a time. A half that more words share is dealt out over several indexes.
INDEXED = 20_000
#: Runs of more bytes have their checksum one by one.
LONG = 64

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[0xC3] = True


def crc_table() -> np.ndarray:
    """The byte table of the usual 32-bit checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()


def crc_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The checksum of each run of bytes, going on from the checksum `state` of what stands before it."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    out = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    few = int((length > LONG).sum())  # these come first
    for k in range(int(length[few:].max(initial=0))):
        n = int(np.searchsorted(-length, -k))  # runs longer than k
        part = out[few:n]
        out[few:n] = CRC[(part ^ data[start[few:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(few):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(out[i]))
    back = np.empty_like(out)
    back[order] = out
    return back


def word_counts(docs: DataFrame, length: int = LENGTH, every: int = EVERY) -> DataFrame:
    """(word, n): the words of all texts and how often they occur. A null id is as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches):
            data, offsets = common.text_bytes(rows["text"])
            # letters beyond ASCII are the byte C3 and the one after it
            marks = LETTER[data]
            marks[1:] |= data[:-1] == 0xC3
            runs = common.runs(marks.view(np.uint8), offsets)
            leads = np.append(0, np.cumsum(data == 0xC3))
            points = runs.end - runs.start - (leads[runs.end] - leads[runs.start])
            kept = points >= length
            start, end, doc = runs.start[kept], runs.end[kept], runs.doc[kept]
            if not len(start):
                continue
            lower = common.LOWER[data]
            before = np.array([zlib.crc32(f"{x}:".encode()) for x in rows["doc_id"].to_pylist()], np.uint32)
            hit = crc_of(lower, start, end, before[doc])
            changed = np.flatnonzero(hit % np.uint32(every) == 0)
            short = Counter()
            for i, h in zip(changed.tolist(), hit[changed].tolist(), strict=True):
                run = lower[start[i] : end[i]].tobytes().decode()
                at = h % len(run)
                if len(run) > length:
                    short[run[:at] + run[at + 1 :]] += 1
            same = np.ones(len(start), bool)
            same[changed] = False
            start, n = start[same], (end - start)[same]
            ends = np.append(0, np.cumsum(n))
            compact = lower[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])]
            whole = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(compact))
            found = pc.value_counts(whole)
            for words, counts in ((found.field("values"), found.field("counts")), (list(short), list(short.values()))):
                if len(words):
                    yield from pa.table({"word": pa.array(words, pa.string()) if isinstance(words, list) else words.cast(pa.string()), "n": pa.array(counts, pa.int64())}).to_batches(max_chunksize=10_000)

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of the text in order, by doubling the length that is ordered. The last symbol is smallest and alone."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Ranks:
    """The symbols before the suffixes in order, as bits by level, so that counting in an interval is a walk over levels."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_order(text)
        self.before = text[self.order - 1]  # of the whole text it is the last symbol
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))  # suffixes that begin with a smaller symbol
        self.levels, row = [], self.before
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            zero = (row >> bit & 1) == 0
            zeros = np.append(0, np.cumsum(zero)).astype(np.int64)
            self.levels.append((bit, zeros))
            row = np.concatenate([row[zero], row[~zero]])
        self.begin = np.zeros(symbols, np.int64)
        self.begin = self.walk(np.zeros(symbols, np.int64), np.zeros(symbols, np.int64), np.arange(symbols))[0]

    def walk(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of `symbol` among those before the suffixes: how many lie before `low`, how many in [low, high), and how many smaller
        ones lie there."""
        less = np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = (symbol >> bit & 1).astype(bool)
            less += np.where(one, b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return low - self.begin[symbol], high - low, less


class States:
    """Partial matches: of which word, how far it is matched, errors so far, and the interval in either direction."""

    FIELDS = ("word", "place", "error", "low", "other", "width")

    def __init__(self, *columns: np.ndarray):
        self.word, self.place, self.error, self.low, self.other, self.width = columns

    def taken(self, at: np.ndarray) -> States:
        return States(*(getattr(self, f)[at] for f in self.FIELDS))

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts]) for f in States.FIELDS))


class Index:
    """A bidirectional FM-index of words: suffix ranks of their delimited text and of its reverse."""

    END, DELIMITER = 0, 1

    def __init__(self, words: list[str]):
        """`words` are distinct and in order."""
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        length = np.array([len(p) for p in points], np.int64)
        self.alphabet, symbols = np.unique(np.concatenate(points), return_inverse=True)
        text = np.ones(len(symbols) + len(words) + 2, np.int64)  # a delimiter before each word and after the last, then the end
        self.place = np.cumsum(length) - length + np.arange(len(words))  # of each word's delimiter
        inner = np.ones(len(text), bool)
        inner[np.append(self.place, len(text) - 2)] = inner[-1] = False
        text[inner], text[-1] = symbols + 2, self.END
        self.symbols = len(self.alphabet) + 2
        self.left = Ranks(text, self.symbols)  # extends to the left
        self.right = Ranks(np.append(text[-2::-1], self.END), self.symbols)
        self.n = len(text)

    def extended(self, states: States, symbol: np.ndarray, leftward: bool) -> States:
        """The states after one more symbol on that side; those that match nothing are dropped. `low` is in the ranks of that side's
        own index, `other` in the other one's."""
        ranks = self.left if leftward else self.right
        known = np.flatnonzero(symbol < self.symbols)
        if len(known) < len(symbol):
            states, symbol = states.taken(known), symbol[known]
        low, width, less = ranks.walk(states.low, states.low + states.width, symbol)
        out = States(states.word, states.place, states.error, ranks.first[symbol] + low, states.other + less, width)
        return out.taken(np.flatnonzero(width > 0))

    def turned(self, states: States) -> States:
        return States(states.word, states.place, states.error, states.other, states.low, states.width)

    def near(self, queries: list[str], leftward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs of places, one edit apart, that agree in the query's half: its last one if errors lie on the left side,
        else its first. The exact half is matched first, from the middle outwards, then the search turns."""
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in queries]
        n = np.array([len(p) for p in points], np.int64)
        starts, half = np.append(0, np.cumsum(n)), n // 2
        flat = np.append(np.concatenate(points), 0) if points else np.zeros(1, np.uint32)
        symbol = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        letters = np.where(self.alphabet[symbol] == flat, symbol + 2, self.symbols)  # one that no word has

        # a word's halves as seen from the middle: what is matched exactly goes one way, the errors the other
        def letter(states: States, k: np.ndarray | int, size: np.ndarray, left: bool) -> np.ndarray:
            middle = starts[states.word] + half[states.word]
            at = np.clip(middle - 1 - k if left else middle + k, 0, len(letters) - 1)
            return np.where(k < size, letters[at], self.DELIMITER)

        exact, errors = (n - half, half) if leftward else (half, n - half)
        zero = np.zeros(len(n), np.int64)
        states = States(np.arange(len(n)), zero, zero, zero, zero, np.full(len(n), self.n))
        done = []
        for k in range(int(exact.max(initial=-1)) + 1):
            states = self.extended(states, letter(states, k, exact[states.word], not leftward), not leftward)
            full = exact[states.word] == k
            done.append(states.taken(np.flatnonzero(full)))
            states = states.taken(np.flatnonzero(~full))
        active = self.turned(States.joined([states, *done]))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(active.word):
            size = errors[active.word]
            more = active.place < size
            wanted = letter(active, active.place, size, leftward)
            # the other half is matched with one error: the delimiter must come next, and the word is known
            closing = active.taken(np.flatnonzero(~more & (active.error == 1)))
            closed = self.extended(closing, np.full(len(closing.word), self.DELIMITER), leftward)
            found.append((closed.word, self.word_at(closed.low, leftward)))
            open_ = np.flatnonzero(more)
            went = self.extended(active.taken(open_), wanted[open_], leftward)
            went.place = went.place + 1
            parts = [went]
            clean = np.flatnonzero(active.error == 0)
            if len(clean):
                skipped = active.taken(np.intersect1d(clean, open_))  # a letter of the query is missing
                skipped.place, skipped.error = skipped.place + 1, skipped.error + 1
                which, symbol = self.branches(active.taken(clean), leftward)
                origin = clean[which]
                branch = active.taken(origin)
                branch.error = np.arange(len(origin))  # to know the survivors
                branch = self.extended(branch, symbol, leftward)
                origin, symbol = origin[branch.error], symbol[branch.error]
                branch.error = np.ones(len(origin), np.int64)
                other = symbol != wanted[origin]  # a letter equal to the wanted one is inserted after it just as well
                inserted, replaced = branch.taken(np.flatnonzero(other)), branch.taken(np.flatnonzero(other & more[origin]))
                replaced.place = replaced.place + 1
                parts += [skipped, inserted, replaced]
            active = States.joined(parts)
        query, word = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.divmod(np.unique(query * len(self.place) + word), len(self.place))

    def branches(self, states: States, leftward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) for the letters that may come next: those of a short interval as they are, else all."""
        ranks = self.left if leftward else self.right
        wide = states.width >= self.symbols
        narrow = np.flatnonzero(~wide)
        n = states.width[narrow]
        at = np.repeat(states.low[narrow] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen = np.unique(np.repeat(narrow, n) * self.symbols + ranks.before[at])
        which, symbol = np.divmod(seen, self.symbols)
        kept = symbol > self.DELIMITER
        all_ = np.flatnonzero(wide)
        return (
            np.concatenate([which[kept], np.repeat(all_, self.symbols - 2)]),
            np.concatenate([symbol[kept], np.tile(np.arange(2, self.symbols), len(all_))]),
        )

    def word_at(self, low: np.ndarray, leftward: bool) -> np.ndarray:
        """The word of a match from delimiter to delimiter, found by its suffix rank."""
        if leftward:
            return np.searchsorted(self.place, self.left.order[low])
        # in the reversed text the match begins at the delimiter after the word
        return np.searchsorted(self.place, self.n - 2 - self.right.order[low]) - 1


def dealt(words: DataFrame, indexed: int) -> DataFrame:
    """(side, key, salt, word, n, query, index): each word to the halves it is searched with and those it can be found by.

    A word of m letters is searched with its first m // 2 and with the rest. It is found by words of one letter less or more, so by
    two first halves and two last halves. Of a half shared by more than `indexed` words, the words are dealt out over s indexes and the
    queries over s parts, and each part is searched in each index (salt: index * s + part), so that no task holds all of them.
    """
    size = F.length("word")

    def half(side: int, m: Column) -> Column:
        cut = F.floor(m / 2).cast("int")
        return F.left("word", cut) if side == 0 else F.right("word", (m - cut).cast("int"))

    def keyed(side: int) -> Column:
        own = half(side, size)
        keys = F.array_distinct(F.array(own, half(side, size - 1), half(side, size + 1)))
        return F.transform(keys, lambda k: F.struct(F.lit(side).alias("side"), F.xxhash64(k).alias("key"), (k == own).alias("query")))

    rows = words.select("word", "n", F.inline(F.concat(keyed(0), keyed(1))))
    rows = write_and_read(rows, "spelling-halves")
    crowded = rows.groupBy("side", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > indexed)
    rows = rows.join(crowded, ["side", "key"], "left").withColumn("s", F.ceil(F.col("rows") / indexed).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("s")).cast("int")
    turns = F.sequence(F.lit(0), F.col("s") - 1)
    as_indexed, as_query = F.transform(turns, lambda b: own * F.col("s") + b), F.transform(turns, lambda a: a * F.col("s") + own)
    salts = F.when(F.col("s").isNull(), F.array(F.lit(-1))).when(F.col("query"), F.array_union(as_indexed, as_query)).otherwise(as_indexed)
    rows = rows.withColumn("own", own).withColumn("salt", F.explode(salts))
    alone = F.col("salt") < 0
    query = F.col("query") & (alone | (F.col("salt") % F.col("s") == F.col("own")))
    index = alone | (F.floor(F.col("salt") / F.col("s")) == F.col("own"))
    return rows.select("side", "key", "salt", "word", "n", query.alias("query"), index.alias("index"))


def compared(indexed: int):
    """For a task with rows sorted by side, key and salt: (word, k, form_n, form) for each searched word with near words."""

    def block(rows: pa.Table, side: int) -> Iterator[pa.RecordBatch]:
        count = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
        names = sorted(set(rows.filter(rows["index"])["word"].to_pylist()))
        queries = sorted(set(rows.filter(rows["query"])["word"].to_pylist()))
        if not names or not queries:
            return
        query, word = Index(names).near(queries, side == 1)
        if side == 1:  # pairs that agree in the query's first half are found by the other scheme
            halves = [w[: len(w) // 2] for w in queries]
            other = [not names[w].startswith(halves[q]) for q, w in zip(query.tolist(), word.tolist(), strict=True)]
            query, word = query[other], word[other]
        if not len(query):
            return
        often = np.array([count[w] for w in names], np.int64)
        order = np.lexsort((word, -often[word], query))
        query, word = query[order], word[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        near = np.diff(np.append(first, len(query)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([queries[q] for q in query[first].tolist()]), pa.array(near), pa.array(often[word[first]]), pa.array([names[w] for w in word[first].tolist()])],
            ["word", "k", "form_n", "form"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def finish() -> Iterator[pa.RecordBatch]:
            yield from block(pa.Table.from_batches(held), last[0])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("side", "key", "salt")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(batch) else []
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                group = tuple(int(c[a]) for c in columns)
                # whole groups share an index up to its size; a dealt-out group has its own, or its queries would meet a word twice
                if last is not None and group != last and (size >= indexed or group[0] != last[0] or group[2] >= 0 or last[2] >= 0):
                    yield from finish()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + b - a, group
        if held:
            yield from finish()

    return search


def near_words(words: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near words: the most frequent of these, ties by code point."""
    rows = dealt(words, indexed).repartition("side", "key", "salt").sortWithinPartitions("side", "key", "salt", "word")
    found = rows.mapInArrow(compared(indexed), "word string, k long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("down"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best).select("word", "n_near", (-F.col("best.down")).alias("form_n"), "best.form")


def variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, every: int = EVERY, times: int = TIMES, indexed: int = INDEXED) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of at least `length` code points and `count` occurrences.

    form is the word's most frequent near word if that is at least `times` as frequent, root what following forms ends at. Null and
    empty texts have no words; rows that repeat count each. Other columns than doc_id and text are not read.
    """
    words = write_and_read(word_counts(docs, length, every).where(F.col("n") >= count), "spelling-words")
    near = write_and_read(near_words(words, indexed), "spelling-near")
    rows = words.join(near, "word", "left")
    chosen = F.col("form_n") >= times * F.col("n")
    rows = rows.select("word", F.when(chosen, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("form_n")).alias("form_n"))
    rows = write_and_read(rows, "spelling-forms")
    # a form is `times` as frequent as its word, so chains are as short as the logarithm of the largest count; each round doubles
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = write_and_read(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
