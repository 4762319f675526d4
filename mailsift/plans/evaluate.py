"""Scoring and triage: out-of-fold and held-out evaluation of the three feature sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce

from pyspark.ml.base import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import blank_sentinel, number_or_zero, strict_label
from ..operators import assemble, embed, folds, metrics, models, scale, tfidf
from ..operators.boost import Booster
from ..session import side_by_side, write_and_read

MakeClassifier = Callable[[int], Estimator | Booster]


def default_classifier(rows: int) -> Booster:
    """Boosted trees at their default settings, fitted on all rows."""
    return Booster()


def base_features(
    clean: DataFrame, load_encoder=None, stop_words: Sequence[str] | None = tfidf.ENGLISH, stored: bool = True
) -> DataFrame:
    """(email_id, label, twelve numbers, tokens, embedding_vector) of the labelled emails.

    What every fold needs alike is computed once. `stored` writes it to the shared folder, so that the
    many fits read a table instead of going back to the raw text.
    """
    df = clean.where(F.col("label").isNotNull()).select(
        "email_id",
        strict_label(F.col("label")).alias("label"),
        *[number_or_zero(F.col(c)).alias(c) for c in assemble.TABULAR],
        blank_sentinel(F.col("email_text_clean")).alias("text"),
    )
    df = tfidf.with_tokens(df, "text", stop_words)
    df = embed.embed_text(df, "text", load_encoder)
    df = assemble.embedding_as_vector(df).drop("embedding")
    return write_and_read(df, "features") if stored else df


def prepared(
    train: DataFrame, held_out: DataFrame, feature_sets: Sequence[str], max_features: int = 1000, held: list[DataFrame] | None = None
):
    """Train and held-out rows with the blocks of all wanted feature sets, fitted on `train` alone.

    The tf-idf fit is shared by the feature sets that use it. Given a list, the training rows are held in memory without their words
    from when these are counted on, and what has to be let go is added to the list.
    """

    def hold(df: DataFrame) -> DataFrame:
        if held is None:
            return df
        held.append(df.drop("tokens").persist())
        return held[-1]

    if set(feature_sets) & {"pure_tfidf", "fused"}:
        counter = tfidf.limited_counter(train, "tokens", (1, 3), max_features)
        counted = hold(counter.transform(train, "tokens", "__tf"))
        weighting = tfidf.fit_weighting(counted, "__tf")
        train = weighting.transform(counted, "__tf", "tfidf").drop("__tf")
        held_out = tfidf.Tfidf(counter, weighting).transform(held_out)
    else:
        train = hold(train)
    if "fused" in feature_sets:
        scaling = scale.fit_scaling(train, assemble.TABULAR)
        train, held_out = scaling.transform(train), scaling.transform(held_out)
    return train, held_out


def _scores(parts: Sequence[tuple[DataFrame, DataFrame, dict]], feature_sets, max_features, make) -> DataFrame:
    """The scores of each part's held-out rows (part: training rows, held-out rows, columns to add) for each feature set."""
    spark, held = parts[0][0].sparkSession, []

    def ready(train: DataFrame, held_out: DataFrame, marks: dict) -> tuple:
        train, held_out = prepared(train, held_out, feature_sets, max_features, held)
        return train, held_out, train.count(), marks

    def scored(feature_set: str, train: DataFrame, held_out: DataFrame, rows: int, marks: dict) -> DataFrame:
        fit_on = assemble.fuse(train, feature_set).select("label", "features")
        test = assemble.fuse(held_out, feature_set)
        part = models.fit_and_score(make(rows), fit_on, test, ["email_id", "label"])
        return part.withColumns({"feature_set": F.lit(feature_set), **{k: F.lit(v) for k, v in marks.items()}})

    def size(feature_set: str) -> tuple[bool, int]:
        blocks = assemble.block_columns(feature_set)
        return "tfidf" in blocks, len(blocks)

    try:
        ready_parts = side_by_side(spark, [partial(ready, *part) for part in parts], 3)
        # a model is fitted in one task, so those of all parts and feature sets share the cluster, the longest fits first
        jobs = [partial(scored, f, *part) for f in sorted(feature_sets, key=size, reverse=True) for part in ready_parts]
        # no more at a time than can run, as their plans are in the driver
        return reduce(DataFrame.unionByName, side_by_side(spark, jobs, min(len(jobs), max(3, spark.sparkContext.defaultParallelism))))
    finally:
        for df in held:
            df.unpersist()


def _fold_parts(folded: DataFrame, k: int, marks: Callable[[int], dict]) -> list[tuple[DataFrame, DataFrame, dict]]:
    return [(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), marks(f)) for f in range(k)]


def out_of_fold(
    base: DataFrame,
    feature_sets: Sequence[str] = assemble.FEATURE_SETS,
    k: int = 5,
    seed: int = 42,
    max_features: int = 1000,
    make_classifier: MakeClassifier = default_classifier,
) -> DataFrame:
    """(email_id, label, prob, feature_set, fold): every row scored once per feature set, by the model of the
    folds it is not in."""
    folded = folds.stratified_folds(base, k, seed=seed)
    return _scores(_fold_parts(folded, k, lambda f: {"fold": f}), feature_sets, max_features, make_classifier)


def held_out(
    base: DataFrame,
    feature_sets: Sequence[str] = assemble.FEATURE_SETS,
    test_share: float = 0.2,
    seed: int = 42,
    max_features: int = 1000,
    make_classifier: MakeClassifier = default_classifier,
) -> DataFrame:
    """(email_id, label, prob, feature_set) of the test rows, scored by models of all training rows."""
    split = folds.stratified_split(base, test_share=test_share, seed=seed)
    train, test = split.where("NOT is_test"), split.where("is_test")
    return _scores([(train, test, {})], feature_sets, max_features, make_classifier)


def train_test_evaluation(
    base: DataFrame,
    feature_sets: Sequence[str] = assemble.FEATURE_SETS,
    k: int = 5,
    test_share: float = 0.2,
    seed: int = 42,
    max_features: int = 1000,
    make_classifier: MakeClassifier = default_classifier,
) -> DataFrame:
    """One metric row per feature set and evaluation set: cross-validation on the training part, then the
    held-out part."""
    split = folds.stratified_split(base, test_share=test_share, seed=seed)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    folded = folds.stratified_folds(train, k, seed=seed)
    parts = [*_fold_parts(folded, k, lambda _: {"eval_set": "cross_validation"}), (train, test, {"eval_set": "held_out"})]
    scored = _scores(parts, feature_sets, max_features, make_classifier)
    return metrics.evaluation(write_and_read(scored, "scores"), ["feature_set", "eval_set"])
