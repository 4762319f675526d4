"""Line quality, lexical search and spelling variants against enumeration, SQL-like brute force and edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailsift.llm import common, lexical, lines, queries, spelling

DOCS = "doc_id long, text string, item_id long, score double, word string, n long, terms string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as results are."""
    base = "The lantern keeper walked slowly\nacross the harbour bridge\n\nand counted lanterns 12 times."
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\n"), (None, base), (None, None), (6, "x\n" * 30_000), (7, "lantern " * 20_000),
        (8, "éclairage ÉCLAIRAGE eclairage ☃ 日本語"), (9, "MENU | HOME | $$$ ### | &&&\nMENU | HOME | $$$ ###"), (10, "a" * 1500),
    ]
    return spark.createDataFrame([(i, t, 0, 0.5, "w", 1, "t") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# line quality


def chain(scores, ties):
    """Unnormalised weights of all labellings of one text."""
    for labels in itertools.product((0, 1), repeat=len(scores)):
        weight = sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(ties[2 * a + b] for a, b in itertools.pairwise(labels))
        yield labels, math.exp(weight)


def test_marginals_and_likelihood_equal_enumeration():
    r = np.random.default_rng(0)
    parsed = lines.lines_of(pa.array(["a\nb\nc\nd", "", "x\n", "q\nr\ns", "one"]))
    assert parsed.per_doc.tolist() == [4, 1, 2, 3, 1]
    scores, ties, labels = r.normal(size=11), r.normal(size=4), r.integers(0, 2, 5)
    of_line = np.repeat(labels, parsed.per_doc).astype(float)  # in training, lines bear the mark of their text
    good, pairs, at = lines.marginals(parsed, scores, ties)
    loss, k, p = 0.0, 0, 0
    for n, label in zip(parsed.per_doc, labels, strict=True):
        each = list(chain(scores[k : k + n], ties))
        total = sum(w for _, w in each)
        for i in range(n):
            assert good[k + i] == pytest.approx(sum(w for y, w in each if y[i]) / total)
        for i in range(1, n):
            expected = [sum(w for y, w in each if (y[i - 1], y[i]) == ab) / total for ab in itertools.product((0, 1), repeat=2)]
            assert at[p] == k + i and pairs[p] == pytest.approx(expected)
            p += 1
        loss -= math.log(next(w for y, w in each if set(y) <= {label}) / total)
        k += n
    assert lines.log_loss(parsed, scores, ties, of_line) == pytest.approx(loss)


def test_line_measures_by_hand():
    parsed = lines.lines_of(pa.array(["AB cd\n\nAB cd", None]))
    assert parsed.per_doc.tolist() == [3, 1] and parsed.length.tolist() == [5, 0, 5, 0] and parsed.n_words.tolist() == [2, 0, 2, 0]
    cells = (parsed.cells - np.arange(lines.PER_LINE) * (lines.BINS + 1)).reshape(4, 3, lines.MEASURES)
    assert cells[:, 0, 3].tolist() == [7 - 1, 0, 6, 0]  # half of the letters are upper case
    assert cells[:, 0, 10].tolist() == [0, 0, 1, 0]  # the third line repeats the first
    assert (cells[[0, 3], 1] == lines.BINS).all() and (cells[[2, 3], 2] == lines.BINS).all()  # no line there
    assert (cells[1, 1] == cells[0, 0]).all() and (cells[1, 2] == cells[2, 0]).all()


def test_long_chain_in_few_steps():
    parsed = lines.lines_of(pa.array(["x\n" * 200_000]))
    good, *_ = lines.marginals(parsed, np.full(200_001, 0.1), np.array([5.0, -5, -5, 5]))
    assert np.isfinite(good).all() and good.min() > 0.5


def test_line_quality_on_documents_it_has_not_seen(spark):
    rows = queries.op11_line_quality(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [(r["predicted"] == r["quality"]) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) > 0.95
    pairs = [(a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in rows for b in rows if a["quality"] > b["quality"]]
    assert sum(pairs) / len(pairs) > 0.97


def test_line_quality_learns_nothing_from_held_out_rows(spark):
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(lines.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in lines.line_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b
    renamed = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"))
    assert a == {r["doc_id"]: r["score"] for r in lines.line_quality(renamed, labels).collect()}


def test_line_quality_edges(spark, odd, empty):
    marks = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(i, int(i < 5), "") for i in range(40)] + [(1, 1, ""), (9, 1, ""), (3, None, ""), (None, 1, ""), (2, 7, "")], marks)
    rows = lines.line_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["n_lines"] for r in rows if r["doc_id"] == 6} == {30_001}
    assert lines.line_quality(empty, labels).count() == 0
    assert {r["score"] for r in lines.line_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in lines.line_quality(empty.union(odd), labels.where("quality = 1")).collect()} == {0.5}


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked_brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for (i, c), n in zip(counts, sizes, strict=True):
            m = 100 - 50 + (50 * n * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_ranked_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 100)
    monkeypatch.setattr(lexical, "LEAF", 3)
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ünder", "a_b", "日本"]
    texts = [" ".join(r.choice(vocabulary[: r.choice([5, 20, 64])]) for _ in range(r.randint(0, 30))) for _ in range(500)]
    docs = list(enumerate(texts + texts[:200] + [None, ""]))
    items = [(k, " ".join(r.sample(vocabulary, r.randint(0, 12)))) for k in range(20)] + [(3, "w1 w1"), (None, "w2"), (77, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    expected = ranked_brute(docs, items, 7)
    assert found(lexical.ranked(*frames, top=7)) == expected
    assert found(lexical.ranked(*frames, top=7, most=20)) == expected  # queries in several blocks


def test_bounds_hold_and_prune():
    r = np.random.default_rng(1)
    # two kinds of documents without a common term
    rows = [np.unique(r.integers(0, 50, 12) + 50 * (k % 2)) for k in range(400)]
    starts = np.append(0, np.cumsum([len(x) for x in rows]))
    sparse = lexical.Sparse(starts, np.concatenate(rows), r.integers(1, 10**10, starts[-1]))
    ids = np.empty(400, object)
    ids[:] = [(True, -k) for k in range(400)]
    tree = lexical.Ball(sparse, ids, 100)

    def scores(node, wanted):
        if node.halves:
            below = np.concatenate([scores(h, wanted) for h in node.halves])
        else:
            below = node.rows.times(wanted.astype(np.int64))
        assert below.max() <= node.bound(wanted)
        return below

    wanted = np.zeros(100, bool)
    wanted[[3, 9, 20]] = True
    assert sorted(scores(tree, wanted)) == sorted(sparse.times(wanted.astype(np.int64)))

    def leaves(node):
        return sum(map(leaves, node.halves)) if node.halves else 1

    best = lexical.Best(5)
    assert best.search(tree, np.flatnonzero(wanted), wanted) <= 0.75 * leaves(tree)
    assert sorted((s for s, *_ in best.heap), reverse=True) == sorted(sparse.times(wanted.astype(np.int64)), reverse=True)[:5]


def test_ranked_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "lantern Lantern bridge", 5), (2, None, 5), (3, "", 5), (4, "nowhere", 5), (None, "x", 5)], "item_id long, text string, doc_id long")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(lexical.ranked(odd, items)) == ranked_brute(rows, [(r["item_id"], r["text"]) for r in items.collect()], 50)
    nothing = lexical.ranked(empty, items)
    assert nothing.count() == 0 and lexical.ranked(odd, items.limit(0)).count() == 0
    assert nothing.columns == ["item_id", "rank", "doc_id", "score"]


# spelling variants


def apart(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_schemes_equal_all_pairs():
    r = random.Random(1)
    for _ in range(40):
        letters = "abé"[: r.choice([1, 2, 3])]
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.choice([1, 5, 60]))})
        asked = sorted({"".join(r.choice(letters + "z") for _ in range(r.randint(2, 9))) for _ in range(20)} | set(words))
        index = spelling.Index(words)
        for leftward in (False, True):
            query, word = index.near(asked, leftward)
            expected = {
                (i, j) for i, a in enumerate(asked) for j, b in enumerate(words)
                if apart(a, b) and (b.endswith(a[len(a) // 2 :]) if leftward else b.startswith(a[: len(a) // 2]))
            }
            assert set(zip(query.tolist(), word.tolist(), strict=True)) == expected and len(query) == len(expected)


def test_intervals_keep_both_directions():
    index = spelling.Index(["banana", "bandana", "cabana"])
    text = "$banana$bandana$cabana$\0"
    r = random.Random(4)
    for _ in range(200):
        states = spelling.States(*(np.array([x]) for x in (0, 0, 0, 0, 0, index.n)))
        pattern, left = "", True
        for _ in range(r.randint(1, 5)):
            symbol, leftward = r.choice("$abcdn"), r.random() < 0.5
            if leftward != left:
                states, left = index.turned(states), leftward
            states = index.extended(states, np.array([1 if symbol == "$" else 2 + "abcdn".index(symbol)]), leftward)
            pattern = symbol + pattern if leftward else pattern + symbol
            places = [i for i in range(len(text)) if text.startswith(pattern, i)]
            assert len(states.word) == bool(places)
            if not places:
                break
            own = states if left else index.turned(states)
            low, other, width = int(own.low[0]), int(own.other[0]), int(own.width[0])
            assert sorted(index.left.order[low : low + width].tolist()) == places
            back = [index.n - 1 - p - len(pattern) for p in index.right.order[other : other + width].tolist()]
            assert sorted(back) == places


def words_brute(docs, length=6, every=199):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                counts[run] += 1
    return counts


def variants_brute(counts, least=5, times=5):
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if counts[f] >= times * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    stems = ["lantern", "harbour", "ÉCLAIRAGE", "straße", "abcdef", "aaaaaaa"]

    def word():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = r.choice(["", "a", "b", "é", "×"])
        return "".join(w)

    docs = [(i, " ".join(word() for _ in range(400)) + (" " + "q" * 300) * 2) for i in range(40)] + [(None, "lantern, lantern"), (7, None), (8, "")]
    expected = variants_brute(words_brute(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {w for w, *_ in expected if len(w) == 300} and any(root not in (w, form) for w, form, root, *_ in expected)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    for indexed in (spelling.INDEXED, 7):  # with 7, common halves are dealt out over several indexes
        rows = {tuple(x) for x in spelling.variants(frame, indexed=indexed).select(*columns).collect()}
        assert rows == expected


def test_checksums_equal_zlib():
    r = np.random.default_rng(6)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    start = r.integers(0, 4500, 300)
    end = start + r.integers(0, 150, 300)
    state = np.array([zlib.crc32(str(k).encode()) for k in range(300)], np.uint32)
    expected = [zlib.crc32(str(k).encode() + data[a:b].tobytes()) for k, (a, b) in enumerate(zip(start, end, strict=True))]
    assert spelling.crc_of(data, start, end, state).tolist() == expected


def test_variants_edges(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = {tuple(r) for r in spelling.variants(odd, count=1).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == variants_brute(words_brute(rows), least=1)
    assert spelling.variants(empty).count() == 0 and spelling.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
