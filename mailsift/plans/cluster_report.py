"""Embeddings: clusters, projection, and cross-validated logistic regression."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, folds, models


def scale_vectors(train: DataFrame, *others: DataFrame, features: str = "features", out: str = "scaled") -> list:
    """Centre and divide by the population deviation, fitted on `train`; returns train and the others, scaled."""
    row = train.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    n = row["count"]
    shrink = (n - 1) / n if n else 0.0
    means = [float(m) for m in row["mean"]]
    eps = 2.220446049250313e-16
    divisors = []
    for m, v in zip(means, row["variance"]):
        var = float(v) * shrink
        divisors.append(var**0.5 if var > n * eps * var + (n * m * eps) ** 2 else 1.0)
    shift, divide = (F.array(*[F.lit(x) for x in xs]) for xs in (means, divisors))

    def apply(df: DataFrame) -> DataFrame:
        centred = F.zip_with(vector_to_array(features), shift, lambda x, m: x - m)
        scaled = F.zip_with(centred, divide, lambda x, d: x / d)
        return df.withColumn(out, array_to_vector(scaled))

    return [apply(df) for df in (train, *others)]


def cross_validated_logistic(
    df: DataFrame,
    k: int = 5,
    seed: int = 42,
    max_iter: int = 1000,
    row_id: str = "vec_id",
    scale_scope: str = "global",
) -> DataFrame:
    """(row_id, label, prob, fold) by class-balanced logistic regression on scaled embeddings.

    `scale_scope="global"` scales on all rows before the folds; "fold" on the training folds only.
    """
    if scale_scope not in ("global", "fold"):
        raise ValueError(f"unknown scale_scope {scale_scope!r}")
    base = clusters.with_vector(df.where(F.col("label").isNotNull())).select(row_id, "label", "features")
    if scale_scope == "global":
        (base,) = scale_vectors(base)
    folded = folds.stratified_folds(base, k, row_id=row_id, seed=seed)

    def run(train, held_out, fold):
        if scale_scope == "fold":
            train, held_out = scale_vectors(train, held_out)
        fit_on = models.with_class_weight(train.drop("features").withColumnRenamed("scaled", "features")).persist()
        test = held_out.drop("features").withColumnRenamed("scaled", "features")
        model = models.logistic(fit_on.count(), max_iter, weight="weight")
        scored = models.fit_and_score(model, fit_on, test, [row_id, "label"])
        fit_on.unpersist()
        return scored.withColumn("fold", F.lit(fold))

    return reduce(DataFrame.unionByName, folds.each_fold(folded, k, run))


def clustered(df: DataFrame, k: int = 2, restarts: int = 10, seed: int = 42, row_id: str = "vec_id"):
    """Rows with `cluster`, pc1, pc2 and `mapped_label`, the k-means model and the projection."""
    points = clusters.with_vector(df)
    model = clusters.kmeans_best(points, k, restarts, seed)
    projection = clusters.fit_pca(points, 2)
    rows = model.transform(points).withColumnRenamed("prediction", "cluster")
    rows = projection.transform(clusters.with_majority(rows))
    return rows.select(row_id, "label", "embedding", "cluster", "mapped_label", "pc1", "pc2"), model, projection
