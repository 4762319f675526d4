"""Classifiers and their scores."""

from __future__ import annotations

from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .boost import Booster


def boosted_trees(rounds: int = 150, rate: float = 0.08, depth: int = 6, seed: int = 42) -> GBTClassifier:
    """MLlib's trees, fitted on all rows. The evaluations use `Booster` unless told otherwise."""
    return GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, labelCol="label")


def logistic(rows: int, max_iter: int = 100, weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression with unit inverse strength.

    The penalty there is w'w / 2 against the summed loss; Spark's loss is a mean, hence 1 / rows.
    """
    model = LogisticRegression(regParam=1.0 / rows, standardization=False, maxIter=max_iter, labelCol="label")
    return model.setWeightCol(weight) if weight else model


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * n_class): (label, n, weight), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # no more rows than classes reach the total
    totals = counts.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__classes")).first()
    weight = F.lit(totals["__total"]) / (F.lit(totals["__classes"]) * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class, as constants in an expression."""
    choice = F.lit(None).cast("double")
    for row in class_weights(df, label).collect():
        choice = F.when(F.col(label) == F.lit(row[label]), F.lit(row["weight"])).otherwise(choice)
    return df.withColumn(out, choice)


def fit_and_score(classifier: Estimator | Booster, train: DataFrame, held_out: DataFrame, keep: list[str]) -> DataFrame:
    """Fit on `train`, score `held_out`: the columns `keep` and `prob`, the probability of class 1."""
    if isinstance(classifier, Booster):
        return classifier.fit_and_score(train, held_out, keep)
    if classifier.hasParam("checkpointInterval"):  # the boosted trees cut their lineage there
        shared_folder(train.sparkSession)
    model = classifier.fit(train)
    return model.transform(held_out).select(*keep, vector_to_array("probability")[1].alias("prob"))


def predicted(prob: str = "prob", threshold: float = 0.5):
    """Class 1 from the threshold upwards."""
    return (F.col(prob) >= threshold).cast("int")
