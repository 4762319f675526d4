"""Operators on small fixtures, against values written out or computed by brute force in Python."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailsift.functions.ngrams import tokens
from mailsift.operators import assemble, boost, clusters, dedup, embed, folds, grams, lookup, metrics, models, scale, tfidf


def test_dedup_keeps_the_first(spark):
    rows = [(5, "s", "b"), (2, "s", "b"), (3, "sb", ""), (4, "s", "B"), (7, None, "b"), (8, "", "b"), (9, None, "b")]
    df = spark.createDataFrame(rows, "email_id long, subject string, body string").repartition(4)
    kept = dedup.dedup_keep_first(df, ["subject", "body"])
    assert kept.columns == df.columns
    assert sorted(r["email_id"] for r in kept.collect()) == [2, 3, 4, 7, 8]
    assert tuple(dedup.duplicate_count(df, ["subject", "body"]).first()) == (7, 5, 2)
    assert tuple(dedup.duplicate_count(df.limit(0), ["subject", "body"]).first()) == (0, 0, 0)


def test_dedup_with_one_text_on_a_third_of_the_rows(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("email_id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("subject"),
        F.lit("b").alias("body"),
    )
    kept = dedup.dedup_keep_first(df.repartition(6), ["subject", "body"])
    assert kept.count() == 20_001
    assert kept.where("subject = 'same'").first()["email_id"] == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 1])
def test_lookup_flags(spark, broadcast_rows):
    df = spark.createDataFrame(
        [(1, "example.com"), (2, "EXAMPLE.com"), (3, None), (4, "mail.example.com"), (5, "b.org"), (6, "example.com")],
        "email_id long, d string",
    )
    listed = spark.createDataFrame([("example.com",), ("example.com",), ("b.org",), (None,)], "domain string")
    flagged = lookup.flag_members(df, "d", listed, "domain", "known", broadcast_rows=broadcast_rows)
    assert {r["email_id"]: r["known"] for r in flagged.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1}
    assert flagged.count() == 6


def md5_order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}#{seed}".encode()).hexdigest())


def labelled(spark, n, share=7):
    return spark.range(n).select(F.col("id").alias("email_id"), (F.col("id") % share == 0).cast("int").alias("label"))


@pytest.mark.parametrize("n", [10, 399, 5000])
def test_stratified_split_takes_the_lowest_keys(spark, n):
    rows = folds.stratified_split(labelled(spark, n)).collect()
    by_label = {c: [r["email_id"] for r in rows if r["label"] == c] for c in (0, 1)}
    wanted = math.ceil(n * 0.2)
    test = {r["email_id"] for r in rows if r["is_test"]}
    assert len(test) == wanted and len(rows) == n
    for ids in by_label.values():
        taken = len(test & set(ids))
        assert abs(taken - len(ids) * wanted / n) < 1
        assert set(md5_order(ids, 42)[:taken]) == test & set(ids)


def test_stratified_folds_have_dealt_sizes(spark):
    rows = folds.stratified_folds(labelled(spark, 403), 5).collect()
    labels = sorted(r["label"] for r in rows)
    for fold in range(5):
        assert Counter(labels[fold::5]) == Counter(r["label"] for r in rows if r["fold"] == fold)
    again = {r["email_id"]: r["fold"] for r in folds.stratified_folds(labelled(spark, 403).repartition(3), 5).collect()}
    assert again == {r["email_id"]: r["fold"] for r in rows}
    with pytest.raises(ValueError):
        folds.stratified_folds(labelled(spark, 4), 5)


def test_plain_folds(spark):
    rows = folds.plain_folds(labelled(spark, 23), 5).collect()
    assert sorted(Counter(r["fold"] for r in rows).items()) == [(0, 5), (1, 5), (2, 5), (3, 4), (4, 4)]
    other = {r["email_id"]: r["fold"] for r in folds.plain_folds(labelled(spark, 23), 5, seed=1).collect()}
    assert other != {r["email_id"]: r["fold"] for r in rows}


def test_cut_keys_refuses_repeated_ids(spark):
    same = spark.createDataFrame([(1, 0)] * 10, "email_id long, label int")
    with pytest.raises(ValueError):
        folds.stratified_folds(same, 5)


TEXTS = [
    "free money now free money",
    "meeting notes for monday",
    "free offer: money back now",
    "notes notes notes",
    "",
    "the and of",
    "monday meeting free",
]


def brute_tfidf(texts, low, high, limit):
    stop = set(tfidf.ENGLISH)
    docs = []
    for t in texts:
        words = [w for w in __import__("re").findall(r"\w\w+", t.lower()) if w not in stop]
        docs.append(Counter(" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)))
    total = sum(docs, Counter())
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in d for d in docs))) + 1 for t in vocabulary}
    out = {}
    for i, d in enumerate(docs):
        w = {t: d[t] * idf[t] for t in vocabulary if t in d}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.update({(i, t): x / norm for t, x in w.items()})
    return total, out


@pytest.mark.parametrize("limit", [1, 3, 4, 6, 9, 1000])
@pytest.mark.parametrize("span", [(1, 3), (1, 1), (2, 3)])
def test_tfidf_against_brute_force(spark, limit, span):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "email_id int, text string").select(
        "email_id", tokens(F.col("text")).alias("tokens")
    )
    total, want = brute_tfidf(TEXTS, *span, limit)
    top = [(r["term"], r["term_count"]) for r in tfidf.top_terms(df, "tokens", span, limit).collect()]
    assert sorted(top) == sorted(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit])
    fitted = tfidf.fit_tfidf(df, "tokens", span, limit)
    got = {(r["email_id"], r["term"]): r["weight"] for r in fitted.long_weights(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_top_terms_pruning_on_random_text(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.8)) % 60}x" for _ in range(4000)]
    texts = [" ".join(words[i : i + rng.randint(1, 40)]) for i in range(0, 4000, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "email_id int, text string").select(
        "email_id", tokens(F.col("text")).alias("tokens")
    )
    for limit in (5, 20, 30):
        total, _ = brute_tfidf(texts, 1, 3, limit)
        want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]
        assert [tuple(r) for r in tfidf.top_terms(df, "tokens", (1, 3), limit).collect()] == want


def test_full_counter_exact_and_hashed(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "email_id int, text string").select(
        "email_id", tokens(F.col("text")).alias("tokens")
    )
    total, _ = brute_tfidf(TEXTS, 1, 2, 10**6)
    assert tfidf.full_counter(df, ngram_range=(1, 2)).size == len(total)
    hashed = tfidf.full_counter(df, ngram_range=(1, 2), hash_bits=10)
    assert hashed.size == 1024
    counted = hashed.transform(df)
    sums = [sum(r["tf"].values) for r in counted.orderBy("email_id").collect()]
    assert sums == [7, 5, 7, 5, 0, 0, 5]
    with pytest.raises(ValueError):
        tfidf.full_counter(df.where("email_id = 4"))


def test_unseen_terms_weigh_nothing(spark):
    """Counting on all rows and dropping terms unseen in training equals fitting on the training rows."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "email_id int, text string").select(
        "email_id", tokens(F.col("text")).alias("tokens")
    )
    train, test = df.where("email_id < 3"), df.where("email_id >= 3")
    counter = tfidf.full_counter(df, ngram_range=(1, 2))
    weighting = tfidf.fit_weighting(counter.transform(train), drop_unseen=True)
    ours = weighting.transform(counter.transform(test)).orderBy("email_id").collect()
    refit = tfidf.fit_tfidf(train, ngram_range=(1, 2), max_features=10**6).transform(test).orderBy("email_id").collect()
    for a, b in zip(ours, refit):
        assert sorted(x for x in a["tfidf"].values if x) == pytest.approx(sorted(b["tfidf"].values))


def test_scaling(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1), (3, 4.0, 0.1), (8, 9.0, 0.1)], "a int, b double, c double")
    fitted = scale.fit_scaling(df, ["a", "b", "c"])
    got = np.array([tuple(r) for r in fitted.transform(df).collect()])
    want = np.array([[1, 2, 0], [3, 4, 0], [8, 9, 0]], dtype=float)
    want[:, :2] = (want[:, :2] - want[:, :2].mean(axis=0)) / want[:, :2].std(axis=0)
    assert np.allclose(got, want)


def test_embedding_contract(spark):
    sizes = spark.sparkContext.accumulator(0)
    rows = [(i, i % 2, f"text number {i}" if i % 5 else None) for i in range(70)]
    df = spark.createDataFrame(rows, "email_id long, label int, t string").coalesce(1)

    def load():
        def encode(texts):
            assert len(texts) <= 32
            sizes.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    out = embed.embed_text(df, "t", load)
    assert out.columns == ["email_id", "label", "embedding"]
    got = {r["email_id"]: r["embedding"] for r in out.collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, _, t in rows}
    assert sizes.value == 70
    built_in = embed.embed_text(df, "t").collect()
    assert all(len(r["embedding"]) == 64 for r in built_in)
    norms = {r["email_id"]: sum(x * x for x in r["embedding"]) for r in built_in}
    assert norms[0] == 0 and norms[1] == pytest.approx(1, abs=1e-6)


def test_built_in_encoder_reads_whole_texts():
    encode = embed.hashed_projection(16)()
    short = embed.hashed_projection(16, max_tokens=256)()
    text = " ".join(f"word{i}" for i in range(5000))
    assert not np.allclose(encode([text]), short([text]))
    assert np.allclose(short([text]), encode([" ".join(text.split()[:256])]))


def test_fuse_orders_blocks(spark):
    from pyspark.ml.linalg import Vectors

    row = {c: float(i) for i, c in enumerate(assemble.TABULAR)}
    df = spark.createDataFrame([(*row.values(), Vectors.sparse(3, {1: 0.5}), Vectors.dense([7.0, 8.0]))], [*row, "tfidf", "embedding_vector"])
    fused = assemble.fuse(df, "fused").first()["features"].toArray()
    assert list(fused) == [*map(float, range(12)), 0, 0.5, 0, 7, 8]
    assert list(assemble.fuse(df, "pure_bert").first()["features"]) == [7, 8]
    assert list(assemble.fuse(df, "pure_tfidf").first()["features"].toArray()) == [0, 0.5, 0]
    with pytest.raises(ValueError):
        assemble.block_columns("other")


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "label int, prob double")


def test_triage_limits(spark):
    df = scored(spark, [(0, 0.2999), (1, 0.30), (1, 0.75), (1, 0.7501)])
    assert {r["triage"]: (r["n"], r["share"]) for r in metrics.triage(df).collect()} == {
        "Inbox": (1, 0.25), "Quarantine": (2, 0.5), "Spam": (1, 0.25)
    }
    assert {r["triage"]: (r["legitimate"], r["spam"]) for r in metrics.triage_crosstab(df).collect()} == {
        "Inbox": (1, 1), "Quarantine": (0, 1), "Spam": (0, 1)
    }


def test_one_class_and_no_rows(spark):
    only = metrics.evaluation(scored(spark, [(0, 0.1), (0, 0.9)])).first()
    assert (only["tn"], only["fp"], only["fn"], only["tp"]) == (1, 1, 0, 0)
    assert only["precision"] == only["recall"] == only["f1"] == 0 and only["fpr"] == 0.5 and only["roc_auc"] is None
    assert metrics.binary_metrics(scored(spark, [(1, 0.9)])).first()["fpr"] is None
    assert tuple(metrics.confusion(scored(spark, []).limit(0)).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("ranges", [2, 7, 1000])
def test_auc_against_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    pairs = [(rng.random() < 0.3, round(rng.random() ** 3, 2)) for _ in range(300)]
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = scored(spark, pairs)
    assert metrics.roc_auc(df, ranges=ranges).first()[0] == pytest.approx(want)
    flipped = metrics.roc_auc(df.withColumn("prob", 1 - F.col("prob")), ranges=ranges).first()[0]
    assert flipped == pytest.approx(1 - want)


def test_classification_report(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2, "label int, pred int")
    got = {r["class"]: r for r in metrics.classification_report(df, "label", "pred").collect()}
    assert got["Legitimate"]["precision"] == pytest.approx(0.6) and got["Legitimate"]["recall"] == 0.75
    assert got["Spam"]["f1"] == pytest.approx(4 / 7) and got["Spam"]["support"] == 4
    assert got["accuracy"]["f1"] == 0.625 and got["macro avg"]["recall"] == pytest.approx(0.625)
    assert got["weighted avg"]["precision"] == pytest.approx((0.6 * 4 + 2 / 3 * 4) / 8)


def test_cluster_majority_tie(spark):
    rows = [(0, 1), (0, 0), (1, 1), (1, 1), (1, 0)]
    df = spark.createDataFrame(rows, "cluster int, label int")
    assert {r["cluster"]: r["majority_label"] for r in clusters.cluster_majority(df).collect()} == {0: 0, 1: 1}
    assert [r["mapped_label"] for r in clusters.with_majority(df).collect()] == [0, 0, 1, 1, 1]


def test_agreement_of_identical_and_single_partitions(spark):
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "label int, cluster int")
    assert clusters.adjusted_rand(same).first()[0] == 1 and clusters.normalized_mutual_info(same).first()[0] == pytest.approx(1)
    one = spark.createDataFrame([(0, 0), (0, 0)], "label int, cluster int")
    assert clusters.adjusted_rand(one).first()[0] == 1 and clusters.normalized_mutual_info(one).first()[0] == 1
    flat = spark.createDataFrame([(0, 0), (1, 0)], "label int, cluster int")
    assert clusters.adjusted_rand(flat).first()[0] == 0 and clusters.normalized_mutual_info(flat).first()[0] == 0


def brute_silhouette(points, own):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(own):
        inside = [d[i, j] for j in range(len(own)) if own[j] == c and j != i]
        if not inside:
            out.append(0.0)
            continue
        a = np.mean(inside)
        b = min(np.mean([d[i, j] for j in range(len(own)) if own[j] == k]) for k in set(own) - {c})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return out


@pytest.mark.parametrize("block_rows", [8192, 40, 7])
def test_silhouette_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(101, 5)).round(3)
    points[:30] = points[0]  # a third are copies
    own = [int(x) for x in rng.integers(0, 3, 100)] + [9]
    df = spark.createDataFrame(
        [(i, p.tolist(), c) for i, (p, c) in enumerate(zip(points, own))], "vec_id long, embedding array<double>, cluster int"
    )
    got = {r["vec_id"]: r["silhouette"] for r in clusters.silhouette_rows(df, block_rows=block_rows).collect()}
    assert [got[i] for i in range(101)] == pytest.approx(brute_silhouette(points, own), abs=1e-6)


def test_pca_and_centroids(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 0.5] + 3
    df = clusters.with_vector(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    fitted = clusters.fit_pca(df)
    got = np.array([[r["pc1"], r["pc2"]] for r in fitted.transform(df).orderBy("vec_id").collect()])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in vt[:2]]
    assert np.allclose(got, centred @ np.array(axes).T)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:2])
    model = clusters.kmeans_best(df, restarts=3)
    centres = clusters.centroids(model, spark)
    assert fitted.transform(centres).count() == 2


def test_logistic_matches_a_direct_solution(spark):
    """The penalty and the class weights mean what they should: compare with Newton's method."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0.7).astype(int)
    weight = len(y) / (2 * np.bincount(y))[y]
    beta = np.zeros(3)
    full = np.c_[x, np.ones(80)]
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ beta))
        gradient = full.T @ (weight * (p - y)) + penalty @ beta
        beta -= np.linalg.solve(full.T @ (full * (weight * p * (1 - p))[:, None]) + penalty, gradient)
    df = clusters.with_vector(
        spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, embedding array<double>, label int")
    )
    model = models.logistic(80, 1000, weight="weight").fit(models.with_class_weight(df))
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-3)


def test_null_labels_are_a_class_of_splits_and_folds(spark):
    rows = [(i, None if i % 5 == 0 else i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "email_id long, label int")
    split = folds.stratified_split(df)
    assert split.where("is_test IS NULL").count() == 0
    assert (split.where("is_test").count(), split.where("NOT is_test").count()) == (10, 40)
    dealt = folds.stratified_folds(df, 5)
    assert sorted(r["count"] for r in dealt.groupBy("fold").count().collect()) == [10] * 5


def test_more_than_a_thousand_classes_are_counted(spark):
    df = spark.range(3000).selectExpr("id AS email_id", "id % 1500 AS label")
    assert folds.class_counts(df, "label") == {c: 2 for c in range(1500)}


def test_document_frequencies_of_sparse_and_dense_vectors(spark):
    rows = [(Vectors.sparse(4, [1, 3], [2.0, 0.0]),), (Vectors.dense([0.0, 1.0, 5.0, 0.0]),), (Vectors.sparse(4, [], []),)]
    fitted = tfidf.fit_weighting(spark.createDataFrame(rows, ["tf"]))
    assert (fitted.rows, fitted.doc_freq) == (3, (0, 2, 1, 0))
    assert tfidf.fit_weighting(spark.createDataFrame(rows, ["tf"]).limit(0)).rows == 0


def test_evaluation_without_scores_stays(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "part string, label int, prob double")
    found = {r["part"]: r for r in metrics.evaluation(df, ["part"]).collect()}
    assert found["a"]["roc_auc"] == 1
    assert found["b"]["roc_auc"] is None and found["b"]["tp"] == 0


def plain_boost(x, y, rounds, rate, depth, penalty=1.0, least=1.0):
    """Boosted trees by looking at every split of every feature, row by row; zeros are absent. The scores of the rows."""
    share = sum(y) / len(y)
    margin = [math.log(share / (1 - share))] * len(y)

    def grow(rows, g, h, left):
        total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best, found = 1e-10, None
        if left:
            for f in range(len(x[0])):
                for absent in (False, True):
                    for cut in sorted({x[i][f] for i in rows} - {0}):
                        side = [i for i in rows if (absent if x[i][f] == 0 else x[i][f] <= cut)]
                        a, b = sum(g[i] for i in side), sum(h[i] for i in side)
                        if b < least or total_h - b < least:
                            continue
                        gain = a * a / (b + penalty) + (total_g - a) ** 2 / (total_h - b + penalty) - total_g**2 / (total_h + penalty)
                        if gain > best + 1e-9:
                            best, found = gain, side
        if found is None:
            return dict.fromkeys(rows, -rate * total_g / (total_h + penalty))
        inside = set(found)
        return {**grow(found, g, h, left - 1), **grow([i for i in rows if i not in inside], g, h, left - 1)}

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        steps = grow(list(range(len(y))), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], depth)
        margin = [m + steps[i] for i, m in enumerate(margin)]
    return [1 / (1 + math.exp(-m)) for m in margin]


def entries_of(x):
    present = x != 0
    return np.append(0, present.sum(axis=1).cumsum()), np.nonzero(present)[1], x[present]


def test_booster_equals_plain_one():
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(60, 4)), 2) * (r.random((60, 4)) < 0.7)  # distinct values, a third of them absent
    y = ((x[:, 0] > 0.1) ^ (x[:, 2] == 0)).astype(float)
    settings = boost.Booster(rounds=6, rate=0.3, depth=3)
    trees = boost.grown(*entries_of(x), 4, y, settings)
    assert trees.score(*entries_of(x)) == pytest.approx(plain_boost(x.tolist(), y.tolist(), 6, 0.3, 3))


def test_booster_bins_at_quantiles():
    values = np.arange(1.0, 1001.0)
    code, first, upper = boost.binned(np.zeros(1000, np.int64), values, 2, 10)
    assert first.tolist() == [0, 10, 10] and upper.tolist() == [100.0 * k for k in range(1, 11)]
    assert np.bincount(code).tolist() == [100] * 10


def test_booster_on_tables(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    rows = [(i, int(v[0] * v[1] > 0), Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(3, [0, 1, 2], v.tolist())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["email_id", "label", "features"])
    train, test = df.where("email_id < 300"), df.where("email_id >= 300")
    scored = boost.Booster(rounds=60).fit_and_score(train, test, ["email_id", "label"]).collect()
    assert len(scored) == 100 and sum((s["prob"] >= 0.5) == s["label"] for s in scored) > 85
    few = boost.Booster(rounds=5, sample=50).fit(train)  # a bounded sample of the rows
    assert few.feature.shape == (5, 127) and (few.feature >= 0).any()
    one = boost.Booster(rounds=3).fit_and_score(train.where("label = 1"), test, ["email_id"]).collect()
    assert all(s["prob"] > 0.99 for s in one)  # one class only: no split, no error
    assert boost.Booster(rounds=2).fit_and_score(train.limit(0), test, ["email_id"]).count() == 100


def test_booster_takes_all_rows(spark):
    """A model used to be fitted on some 100,000 rows, whatever their number."""
    df = spark.range(120_000).select((F.col("id") < 110_007).cast("int").alias("label"), array_to_vector(F.array(F.col("id") % 7 + 1.0)).alias("features"))
    trees = boost.Booster(rounds=1, depth=1).fit(df)
    assert trees.base[0] == pytest.approx(math.log(110_007 / 9_993), rel=1e-12)


def test_booster_deals_features_over_tasks(spark):
    """A model had to fit one task; the same trees come from several."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(300, 7)), 1) * (r.random((300, 7)) < [0.9, 0.2, 1, 0.3, 0.5, 0.05, 0])
    rows = [(int(v[0] * v[2] + v[3] > 0), Vectors.sparse(7, {j: w for j, w in enumerate(v.tolist()) if w})) for v in x]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(5)
    one, many = (boost.Booster(rounds=8, depth=4, bins=20, least=0.1, task_entries=n).fit(df) for n in (10_000, 300))
    for a, b in zip(one.arrays(), many.arrays(), strict=True):
        assert np.array_equal(a, b)
    assert len(np.unique(one.feature)) > 4


def test_range_totals_are_those_of_term_counts(spark):
    """Every length used to be counted, as texts, once for each range that holds it."""
    rows = [(1, ["a", "b", "a", "b", "a"]), (2, ["b", "a"]), (3, []), (4, None), (5, ["c", "a", "b", "a", "b", "é"])]
    df = spark.createDataFrame(rows, "email_id long, tokens array<string>")
    ranges = [(1, 2), (2, 3), (3, 4), (6, 7)]
    found = {r[0]: (r[1], r[2]) for r in tfidf.range_totals(df, "tokens", ranges).collect()}
    for low, high in ranges:
        counts = [r["term_count"] for r in tfidf.term_counts(df, "tokens", (low, high)).collect()]
        assert found[f"{low}-{high}"] == (sum(counts), len(counts))
    empty = tfidf.range_totals(df.where("email_id = 3"), "tokens", [(1, 2)]).collect()
    assert [(r["n_terms"], r["n_distinct"]) for r in empty] == [(None, 0)]


def test_range_totals_in_passes(spark, monkeypatch):
    """The shuffle files of all lengths used to lie on disk until the end."""
    rng = random.Random(12)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "email_id long, tokens array<string>").repartition(3).cache()
    df.count()
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f and f.endswith(".data")}

    before = shuffled()
    monkeypatch.setattr(grams, "GROUP", 100)
    found = {r[0]: (r[1], r[2]) for r in tfidf.range_totals(df, "tokens", [(1, 2), (2, 3), (4, 4), (31, 32)]).collect()}
    for low, high in [(1, 2), (2, 3), (4, 4)]:
        seen = Counter(tuple(t[i : i + n]) for _, t in rows if t for n in range(low, high + 1) for i in range(len(t) - n + 1))
        assert found[f"{low}-{high}"] == (sum(seen.values()), len(seen))
    assert found["31-32"] == (None, 0)
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    df.unpersist()


def test_embed_text_sends_only_the_text(spark):
    df = spark.createDataFrame([(1, ["x"], "a text"), (2, None, None)], "email_id long, tokens array<string>, t string")
    out = embed.embed_text(df, "t")
    assert out.columns == ["email_id", "tokens", "embedding"] and dict(out.dtypes)["embedding"] == "array<float>"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan
    assert {r["email_id"]: r["tokens"] for r in out.collect()} == {1: ["x"], 2: None}


def test_kmeans_starts_share_their_passes(spark):
    """Each start used to make passes of its own, several jobs for each step of each."""
    rng = np.random.default_rng(4)
    middle = np.array([[0.0, 0, 0], [9, 0, 0], [0, 9, 0]]) + 1000
    x = np.concatenate([middle[i] + rng.normal(size=(40, 3)) for i in range(3)])
    df = clusters.with_vector(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("k-means", "k-means")
    try:
        model = clusters.kmeans_best(df, k=3, restarts=8)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("k-means")) < 40
    got = sorted(tuple(c) for c in model.clusterCenters())
    assert np.allclose(got, sorted(tuple(x[40 * i : 40 * i + 40].mean(axis=0)) for i in range(3)))
    own = {r["vec_id"]: r["prediction"] for r in model.transform(df).collect()}
    assert all(len({own[i] for i in range(40 * j, 40 * j + 40)}) == 1 for j in range(3)) and len(set(own.values())) == 3
    centres = np.array(model.clusterCenters())
    assert model.cost == pytest.approx(((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum())
    again = clusters.kmeans_best(df, k=3, restarts=8)
    assert again == model


def test_kmeans_of_odd_rows(spark):
    def points(rows):
        return clusters.with_vector(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"))

    copies = clusters.kmeans_best(points([[1.1, 2.3]] * 30 + [[4.0, 5.7]]), k=3, restarts=2)
    assert np.allclose(sorted(c.tolist() for c in copies.clusterCenters()), [[1.1, 2.3], [4.0, 5.7]]) and copies.cost < 1e-20
    one = clusters.kmeans_best(points([[0.3, 0.7]] * 5), k=2, restarts=2)
    assert [c.tolist() for c in one.clusterCenters()] == [[pytest.approx(0.3), pytest.approx(0.7)]]
    for rows in ([[1.0, 2.0], None], [[1.0, 2.0], [math.nan, 0.0]], [[1.0, 2.0], [math.inf, 0.0]], []):
        with pytest.raises(Exception):
            clusters.kmeans_best(points(rows), restarts=1)
