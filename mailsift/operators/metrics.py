"""Metrics of scored rows (label 0/1, prob). `by` gives one result per method, fold or evaluation set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import predicted

# The triage limits and the names of the groups and classes.
INBOX_BELOW = 0.30
SPAM_ABOVE = 0.75
TRIAGE = ["Inbox", "Quarantine", "Spam"]
CLASS_NAMES = ["Legitimate", "Spam"]

SCORE_RANGES = 1000


def confusion(scored: DataFrame, by: Sequence[str] = (), label: str = "label", pred: Column | None = None) -> DataFrame:
    """Counts tn, fp, fn, tp in one aggregate; all four exist even when only one class does."""
    hit = predicted() if pred is None else pred
    y = F.col(label)
    return scored.groupBy(*by).agg(
        F.count_if((y == 0) & (hit == 0)).alias("tn"),
        F.count_if((y == 0) & (hit == 1)).alias("fp"),
        F.count_if((y == 1) & (hit == 0)).alias("fn"),
        F.count_if((y == 1) & (hit == 1)).alias("tp"),
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on a zero denominator) and false-positive rate (NULL there)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return confusion(scored, by).select(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        share(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(fp, fp + tn).alias("fpr"),
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = (), ranges: int = SCORE_RANGES) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order, ties half.

    Equal scores meet in an aggregate first. The distinct scores are then cut at their quantiles, pairs within
    a range are counted by a running sum inside the range, and pairs across ranges from the totals of
    the ranges, so no task ever orders all scores. NULL when a class is missing.
    """
    keys = list(by)
    y = F.col("label")
    tally = scored.groupBy(*keys, "prob").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = tally.agg(F.percentile_approx("prob", steps, 20 * ranges).alias("c")).first()["c"] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="prob", outputCol="range").transform(tally.where("prob IS NOT NULL"))
    below = F.coalesce(
        F.sum("neg").over(Window.partitionBy(*keys, "range").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    within_range = (
        ranged.withColumn("pairs", F.col("pos").cast("double") * (below + F.col("neg") * 0.5))
        .groupBy(*keys, "range")
        .agg(F.sum("pairs").alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    # from here on at most `ranges` rows per key
    lower = F.coalesce(
        F.sum("neg").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    totals = (
        within_range.withColumn("pairs", F.col("pairs") + F.col("pos").cast("double") * lower)
        .groupBy(*keys)
        .agg(F.sum("pairs").alias("pairs"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    return totals.select(
        *keys, F.try_divide(F.col("pairs"), F.col("pos").cast("double") * F.col("neg")).alias("roc_auc")
    )


def _three_rows(counts: DataFrame, by: Sequence[str], cells: list[Column]) -> DataFrame:
    return counts.select(*by, F.inline(F.array(*cells)))


def triage(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share per triage group, empty groups included. A score on either limit is quarantined."""
    p = F.col("prob")
    counts = scored.groupBy(*by).agg(
        F.count_if(p < INBOX_BELOW).alias("n0"),
        F.count_if((p >= INBOX_BELOW) & (p <= SPAM_ABOVE)).alias("n1"),
        F.count_if(p > SPAM_ABOVE).alias("n2"),
        F.count(F.lit(1)).alias("total"),
    )
    cells = [
        F.struct(
            F.lit(name).alias("triage"),
            F.col(f"n{i}").alias("n"),
            F.try_divide(F.col(f"n{i}"), F.col("total")).alias("share"),
        )
        for i, name in enumerate(TRIAGE)
    ]
    return _three_rows(counts, by, cells)


def triage_crosstab(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Triage group by true class, zero cells kept. Here the groups are right-closed: 0.30 belongs to Inbox."""
    p, y = F.col("prob"), F.col("label")
    groups = [
        (p > -0.01) & (p <= INBOX_BELOW),
        (p > INBOX_BELOW) & (p <= SPAM_ABOVE),
        (p > SPAM_ABOVE) & (p <= 1.01),
    ]
    aggs = []
    for i, group in enumerate(groups):
        aggs += [F.count_if(group & (y == 0)).alias(f"a{i}"), F.count_if(group & (y != 0)).alias(f"b{i}")]
    cells = [
        F.struct(F.lit(name).alias("triage"), F.col(f"a{i}").alias("legitimate"), F.col(f"b{i}").alias("spam"))
        for i, name in enumerate(TRIAGE)
    ]
    return _three_rows(scored.groupBy(*by).agg(*aggs), by, cells)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, pred: str, names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro average and weighted average.

    `names` names the classes 0, 1, ...; a class is listed when it occurs as label or as prediction. The accuracy
    row carries its value in `f1`.
    """
    cells = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n, right = F.col("n"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("c"), n.alias("support"), zero.alias("hits"), right.cast("bigint").alias("tp")),
        F.struct(F.col("p").alias("c"), zero.alias("support"), n.alias("hits"), zero.alias("tp")),
    )
    per_class = (
        cells.select(F.inline(sides))
        .groupBy("c")
        .agg(F.sum("support").alias("support"), F.sum("hits").alias("hits"), F.sum("tp").alias("tp"))
        .select(
            F.get(F.array(*[F.lit(x) for x in names]), F.col("c").cast("int")).alias("class"),
            F.coalesce(F.try_divide(F.col("tp"), F.col("hits")), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"),
            F.coalesce(F.try_divide(2 * F.col("tp"), F.col("hits") + F.col("support")), F.lit(0.0)).alias("f1"),
            "support",
            "tp",
        )
    )
    measures = ("precision", "recall", "f1")
    whole = per_class.agg(
        F.sum("support").alias("support"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures],
    )
    none = F.lit(None).cast("double")

    def row(name, values):
        return F.struct(
            F.lit(name).alias("class"), *[v.alias(m) for m, v in zip(measures, values)], F.col("support").alias("support")
        )

    summary = whole.select(
        F.inline(
            F.array(
                row("accuracy", [none, none, F.col("accuracy")]),
                row("macro avg", [F.col(f"macro_{m}") for m in measures]),
                row("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
            )
        )
    )
    return per_class.drop("tp").unionByName(summary)


def evaluation(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per evaluation: confusion counts, metrics, ROC-AUC and triage counts."""
    p = F.col("prob")
    groups = scored.groupBy(*by).agg(
        F.count_if(p < INBOX_BELOW).alias("inbox"),
        F.count_if((p >= INBOX_BELOW) & (p <= SPAM_ABOVE)).alias("quarantine"),
        F.count_if(p > SPAM_ABOVE).alias("spam"),
    )
    # one row per evaluation on each side; an evaluation without any score has no AUC, but stays
    parts = [binary_metrics(scored, by), roc_auc(scored, by), groups]
    if not by:
        parts = [part.withColumn("__one", F.lit(1)) for part in parts]
    on = list(by) or ["__one"]
    return parts[0].join(parts[1], on, "left").join(parts[2], on).drop("__one")


def size_summary(df: DataFrame, is_test: str = "is_test") -> DataFrame:
    """Rows in all, in training and in test."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~F.col(is_test)).alias("train_rows"),
        F.count_if(F.col(is_test)).alias("test_rows"),
    )


def embedding_shape(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows and width of an embedding table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(embedding)).cast("bigint").alias("n_dims"))
