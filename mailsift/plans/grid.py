"""Search over n-gram ranges with logistic regression on tf-idf."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds, models, ngram_logistic, tfidf
from ..session import side_by_side, write_and_read

# The n-gram ranges compared.
RANGES = [(1, 2), (2, 3), (3, 4), (4, 5)]


def fold_accuracy(
    emails: DataFrame,
    text: str = "body_clean",
    ranges: Sequence[tuple[int, int]] = RANGES,
    k: int = 5,
    seed: int = 42,
    stop_words: Sequence[str] | None = tfidf.ENGLISH,
    max_iter: int = 100,
    hash_bits: int | None = None,
) -> DataFrame:
    """(ngram_range, fold, n, accuracy) with every n-gram kept and the model refitted in every fold.

    The n-grams of each length are counted once. A fold's vocabulary is the set of n-grams in its training rows, so
    weighing all others with zero gives what refitting it would give. The models are fitted in numbers by row, not by
    n-gram, so that no vocabulary has to fit anywhere. With `hash_bits`, all candidates have hashed indices and MLlib fits the
    models; it also does so for labels beyond 0 and 1, on a whole vocabulary in the driver.
    """
    base = emails.where(F.col("label").isNotNull()).select("email_id", F.col("label").cast("int"), text)
    base = tfidf.with_tokens(base, text, stop_words).drop(text).withColumn("place", F.monotonically_increasing_id())
    base = write_and_read(base, "tokens")
    folded = folds.plain_folds(base, k, seed=seed)
    if hash_bits is None and base.where("label NOT IN (0, 1)").isEmpty():
        found = _by_rows(folded, ranges, k, max_iter)
    else:
        found = _by_terms(folded.drop("place"), ranges, k, max_iter, hash_bits)
    return emails.sparkSession.createDataFrame(found, "ngram_range string, fold int, n bigint, accuracy double")


def _by_rows(folded: DataFrame, ranges: Sequence[tuple[int, int]], k: int, max_iter: int) -> list[tuple]:
    rows = ngram_logistic.numbered(folded)
    # three numbers of each row come to the driver, in the order of the rows
    known = rows.select("row", "label", "fold").toArrow().sort_by("row")
    label, fold = (known[c].to_numpy() for c in ("label", "fold"))
    in_train = fold[:, None] != np.arange(k)
    lengths = sorted({n for low, high in ranges for n in range(low, high + 1)})
    sizes = in_train.sum(axis=0).tolist()
    block = min(max(ngram_logistic.BLOCK, 2 * len(label)), 1 << 21)  # a block's sums by row take no longer than its postings
    spark = folded.sparkSession
    made = side_by_side(spark, [partial(ngram_logistic.blocks, rows, "tokens", n, k, sizes, block) for n in lengths])
    parts = dict(zip(lengths, made, strict=True))

    def accuracies(low: int, high: int) -> list[tuple]:
        parts_here = [parts[n] for n in range(low, high + 1)]
        if all(part.isEmpty() for part in parts_here):
            raise ValueError("empty vocabulary: no row has a term")
        odds = ngram_logistic.margins(ngram_logistic.products(parts_here, in_train), label, in_train, max_iter)
        found = []
        for f in range(k):
            tested = ~in_train[:, f]
            right = (odds[tested, f] >= 0) == label[tested]
            found.append((f"{low}-{high}", f, int(tested.sum()), float(right.sum()) / int(tested.sum())))
        return found

    # each step of a fit is a small job, so those of all ranges share the cluster
    return list(chain.from_iterable(side_by_side(spark, [partial(accuracies, *r) for r in ranges])))


def _by_terms(folded: DataFrame, ranges: Sequence[tuple[int, int]], k: int, max_iter: int, hash_bits: int | None) -> list[tuple]:
    found = []
    for low, high in ranges:
        counter = tfidf.full_counter(folded, "tokens", (low, high), hash_bits)
        counted = counter.transform(folded).drop("tokens").persist()

        def run(train, held_out, fold):
            weighting = tfidf.fit_weighting(train, drop_unseen=True)
            fit_on, test = (weighting.transform(part, out="features") for part in (train, held_out))
            scored = models.fit_and_score(models.logistic(weighting.rows, max_iter), fit_on, test, ["label"])
            # one small row per candidate and fold comes back
            row = scored.agg(F.count(F.lit(1)), F.count_if(models.predicted() == F.col("label"))).first()
            return fold, row[0], row[1] / row[0]

        found += [(f"{low}-{high}", *result) for result in folds.each_fold(counted, k, run)]
        counted.unpersist()
    return found


def search(accuracies: DataFrame) -> DataFrame:
    """(ngram_range, mean_accuracy, is_best) of every candidate. Of equal means the first range is best."""
    means = accuracies.groupBy("ngram_range").agg(F.avg("accuracy").alias("mean_accuracy"))
    # one row per candidate
    rank = F.row_number().over(Window.orderBy(F.desc("mean_accuracy"), "ngram_range"))
    return means.withColumn("is_best", rank == 1)
