"""Clustering, projection and cluster quality."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .folds import class_counts

BLOCK_ROWS = 8192
#: k-means ends when no centre moves farther.
TOLERANCE = 1e-4
SCHEMA_DRAWN = pa.schema([("start", pa.int32()), ("wait", pa.float64()), ("row", pa.list_(pa.float64()))])
SCHEMA_MOVED = pa.schema([("totals", pa.list_(pa.float64()))])


def with_vector(df: DataFrame, embedding: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(embedding).cast("array<double>")))


@dataclass(frozen=True)
class Centres:
    """Centres of clusters and the sum of the rows' squared distances to the nearest."""

    centres: tuple[tuple[float, ...], ...]
    cost: float
    features: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as in MLlib
        return [np.array(c) for c in self.centres]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction`, the row's nearest centre; of equally near ones the first."""
        centres = np.array(self.centres)

        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            return pa.array(nearest_centre(squared_distances(matrix(vectors, centres.shape[1]), centres))[0])

        return df.withColumn("prediction", nearest(vector_to_array(F.col(self.features))))


def matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of numbers, all of one width; raises for a row that is null or has a component that is no finite number."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    widths = np.unique(vectors.value_lengths().drop_null().to_numpy(zero_copy_only=False))
    if vectors.null_count or not np.isfinite(flat).all():
        raise ValueError("vectors must not be null, nor hold components that are no finite numbers")
    if len(widths) > 1 or width is not None and len(widths) and widths[0] != width:
        raise ValueError("vectors must have the same width")
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, width or 0))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each centre to each row, (centres, rows); those that rounding may have spoilt are taken from the differences."""
    size = np.add.outer(np.einsum("ij,ij->i", centres, centres), np.einsum("ij,ij->i", x, x))
    out = centres @ x.T
    out *= -2.0
    out += size
    size *= 1e-6
    centre, row = np.nonzero(out < size)
    for a in range(0, len(row), 10_000):
        i, j = row[a : a + 10_000], centre[a : a + 10_000]
        out[j, i] = ((x[i] - centres[j]) ** 2).sum(axis=1)
    return np.maximum(out, 0.0, out=out)


def nearest_centre(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first nearest centre, its distance) of each row. A loop over few centres is faster than argmin along them."""
    least, at = distances[0], np.zeros(distances.shape[1], np.int32)
    for j in range(1, len(distances)):
        at[distances[j] < least] = j
        least = np.minimum(least, distances[j])
    return at, least


def _drawn(points: DataFrame, starts: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """A row for each start, drawn in proportion to the squared distance to its nearest centre so far, or evenly if it has none; no row
    (an empty matrix) if all are at a centre. Each task keeps the row that comes first in a race of exponential clocks of these rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        clocks = np.random.default_rng([seed, max(map(len, starts)), TaskContext.get().partitionId()])
        best, rows = np.full(len(starts), np.inf), [None] * len(starts)
        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            waits = clocks.exponential(size=(len(x), len(starts)))
            for i, centres in enumerate(starts):
                if len(centres):
                    with np.errstate(divide="ignore"):
                        waits[:, i] /= squared_distances(x, centres).min(axis=0)
            first = waits.argmin(axis=0)
            for i in np.flatnonzero(waits[first, np.arange(len(starts))] < best).tolist():
                best[i], rows[i] = waits[first[i], i], x[first[i]].tolist()
        found = [i for i, row in enumerate(rows) if row is not None]
        yield pa.RecordBatch.from_pydict({"start": found, "wait": best[found], "row": [rows[i] for i in found]}, SCHEMA_DRAWN)

    raced = points.mapInArrow(run, "start int, wait double, row array<double>")
    won = {r["start"]: r["row"] for r in raced.groupBy("start").agg(F.min_by("row", F.struct("wait", "row")).alias("row")).collect()}
    return [np.array([won[i]]) if i in won else np.zeros((0, 0)) for i in range(len(starts))]


def _moved(points: DataFrame, starts: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """For each start its centres, each moved to the mean of the rows nearest to it, and the cost before; a centre without rows stays."""
    bounds = np.append(0, np.cumsum([len(c) for c in starts]))
    stacked = np.concatenate(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros(stacked.shape), np.zeros(len(stacked)), np.zeros(len(stacked))
        for batch in batches:
            x = matrix(batch.column(0), stacked.shape[1])
            if not len(x):
                continue
            distances, own = squared_distances(x, stacked), np.zeros((len(stacked), len(x)))
            for low, high in itertools.pairwise(bounds):
                at, least = nearest_centre(distances[low:high])
                for j in range(low, high):
                    own[j] = at == j - low
                costs[low] += least.sum()
            sums += own @ x
            counts += own.sum(axis=1)
        yield pa.RecordBatch.from_pydict({"totals": [np.column_stack([costs, counts, sums]).ravel().tolist()]}, SCHEMA_MOVED)

    # a row of some hundred numbers for each start from each task
    parts = [r["totals"] for r in points.mapInArrow(run, "totals array<double>").collect()]
    totals = np.sum(np.array(parts), axis=0).reshape(len(stacked), -1)
    costs, counts, sums = totals[:, 0], totals[:, 1:2], totals[:, 2:]
    means = np.where(counts > 0, sums / np.maximum(counts, 1.0), stacked)
    pairs = list(itertools.pairwise(bounds))
    return [means[a:b] for a, b in pairs], [float(costs[a:b].sum()) for a, b in pairs]


def kmeans_best(
    df: DataFrame, k: int = 2, restarts: int = 10, seed: int = 42, max_iter: int = 300, features: str = "features"
) -> Centres:
    """The centres with the lowest cost among `restarts` starts of k-means, each begun by k-means++.

    All starts share each pass over the rows, so the number of passes is that of the slowest one, and the rows are held
    once. A start has fewer than k centres if there are fewer distinct rows.
    """
    points = df.select(vector_to_array(F.col(features)).alias("x")).persist()
    held = [points]
    try:
        if points.count() == 0:
            raise ValueError("k-means needs a row")
        dealt = spread(points)
        if dealt is not points:
            held.append(dealt.persist())
        starts = [np.zeros((0, 0))] * restarts
        for _ in range(k):
            starts = [np.concatenate([c, new]) if len(c) and len(new) else c if len(c) else new for c, new in zip(starts, _drawn(dealt, starts, seed))]
        moving = list(range(restarts))
        for _ in range(max_iter):
            moved, _ = _moved(dealt, [starts[i] for i in moving])
            far = [((new - starts[i]) ** 2).sum(axis=1).max() > TOLERANCE**2 for i, new in zip(moving, moved)]
            for i, new in zip(moving, moved):
                starts[i] = new
            moving = [i for i, x in zip(moving, far) if x]
            if not moving:
                break
        costs = _moved(dealt, starts)[1]
        best = min(range(restarts), key=costs.__getitem__)
        return Centres(tuple(tuple(map(float, c)) for c in starts[best]), costs[best], features)
    finally:
        for x in held:
            x.unpersist()


@dataclass(frozen=True)
class Projection:
    """Principal components of centred data. Each component's largest loading is positive."""

    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add pc1, pc2, ... for the vector column."""
        values = vector_to_array(F.col(features))
        out = {}
        for i, axis in enumerate(self.components):
            shift = sum(m * a for m, a in zip(self.mean, axis))
            loadings = F.array(*[F.lit(float(a)) for a in axis])
            dot = F.aggregate(F.zip_with(values, loadings, lambda x, a: x * a), F.lit(0.0), lambda s, v: s + v)
            out[f"pc{i + 1}"] = dot - F.lit(shift)
        return df.withColumns(out)

    def explained_variance(self, spark) -> DataFrame:
        rows = [(i + 1, share) for i, share in enumerate(self.explained)]
        return spark.createDataFrame(rows, "component int, variance_share double")


def fit_pca(df: DataFrame, components: int = 2, features: str = "features") -> Projection:
    model = PCA(k=components, inputCol=features, outputCol="__pc").fit(df)
    mean = df.agg(Summarizer.mean(F.col(features)).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray().T
    axes = [axis * (1 if axis[np.abs(axis).argmax()] >= 0 else -1) for axis in axes]
    return Projection(
        tuple(float(m) for m in mean),
        tuple(tuple(float(a) for a in axis) for axis in axes),
        tuple(float(v) for v in model.explainedVariance.toArray()),
    )


def centroids(model: Centres, spark) -> DataFrame:
    """(cluster, features), one row per cluster."""
    rows = [(i, Vectors.dense(c)) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, ["cluster", "features"]).withColumn("cluster", F.col("cluster").cast("int"))


def cluster_majority(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """The most frequent label of each cluster; of equally frequent ones the smaller: (cluster, majority_label)."""
    counts = df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(cluster).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("majority_label"))


def with_majority(df: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Add `mapped_label`, the majority label of the row's cluster, as constants in an expression."""
    choice = F.lit(None).cast("int")
    for row in cluster_majority(df, cluster, label).collect():
        choice = F.when(F.col(cluster) == F.lit(row[cluster]), F.lit(row["majority_label"])).otherwise(choice)
    return df.withColumn("mapped_label", choice)


def _margins(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Counts of every (label, cluster) cell with both margins and the total, told apart by `level`."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(cluster).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cube = cells.cube("a", "b").agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("level"))
    return cube.select("level", "n")


def adjusted_rand(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row `ari`: agreement on pairs, corrected for chance; 1 for identical partitions."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    sums = _margins(df, label, cluster).agg(
        *[
            F.sum(F.when(F.col("level") == level, pairs)).alias(name)
            for level, name in enumerate(("cells", "by_label", "by_cluster", "total"))
        ]
    )
    chance = F.try_divide(F.col("by_label") * F.col("by_cluster"), F.col("total"))
    top = (F.col("by_label") + F.col("by_cluster")) / 2
    ari = F.when(top == F.coalesce(chance, F.lit(0.0)), F.lit(1.0)).otherwise(
        F.try_divide(F.col("cells") - chance, top - chance)
    )
    return sums.select(ari.alias("ari"))


def normalized_mutual_info(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row `nmi`: mutual information over the mean of the two entropies."""
    n_log_n = F.col("n") * F.ln("n")
    sums = _margins(df, label, cluster).agg(
        *[
            F.sum(F.when(F.col("level") == level, n_log_n)).alias(name)
            for level, name in enumerate(("cells", "by_label", "by_cluster"))
        ],
        F.sum(F.when(F.col("level") == 3, F.col("n"))).alias("total"),
        F.count_if(F.col("level") == 1).alias("labels"),
        F.count_if(F.col("level") == 2).alias("clusters"),
    )
    n = F.col("total")
    label_entropy = F.ln(n) - F.col("by_label") / n
    cluster_entropy = F.ln(n) - F.col("by_cluster") / n
    information = F.ln(n) + (F.col("cells") - F.col("by_label") - F.col("by_cluster")) / n
    nmi = (
        F.when((F.col("labels") == 1) & (F.col("clusters") == 1), F.lit(1.0))
        .when(information <= 2.220446049250313e-16, F.lit(0.0))
        .otherwise(F.try_divide(information, (label_entropy + cluster_entropy) / 2))
    )
    return sums.select(nmi.alias("nmi"))


def silhouette_rows(
    df: DataFrame,
    embedding: str = "embedding",
    cluster: str = "cluster",
    row_id: str = "vec_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The exact Euclidean silhouette of every row: (row_id, cluster, silhouette).

    The definition needs the distance of every row to every other, so the work grows with the square of the
    rows; memory and output do not. Rows are hashed into blocks, each pair of blocks is one task-sized group, and
    a group yields only the sum of distances per row and cluster, never the pairs.
    """
    sizes = class_counts(df.select(cluster).where(F.col(cluster).isNotNull()), cluster)
    if len(sizes) < 2:
        raise ValueError("the silhouette needs at least two clusters")
    blocks = max(1, math.ceil(sum(sizes.values()) / block_rows))
    block = F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int")
    rows = df.select(
        F.col(row_id).alias("id"), F.col(cluster).cast("int").alias("own"), F.col(embedding).alias("v"), block.alias("at")
    )
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "id", "own", "v", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi")
    )

    def distance_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        first = pdf["at"].to_numpy() == pdf["lo"].iat[0]
        same = pdf["lo"].iat[0] == pdf["hi"].iat[0]
        points = np.stack(pdf["v"].to_numpy()).astype("float64")
        square = (points * points).sum(axis=1)
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        kinds, at_kind = np.unique(own, return_inverse=True)
        member = np.eye(len(kinds))[at_kind]
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        left_sums = np.zeros((len(left), len(kinds)))
        right_sums = np.zeros((len(right), len(kinds)))
        for start in range(0, len(left), 512):
            part = left[start : start + 512]
            d2 = square[part, None] + square[None, right] - 2 * points[part] @ points[right].T
            if same:
                d2[np.arange(len(part)), np.arange(start, start + len(part))] = 0.0
            d = np.sqrt(np.maximum(d2, 0.0))
            left_sums[start : start + 512] = d @ member[right]
            if not same:
                right_sums += d.T @ member[part]
        out = [(left, left_sums)] if same else [(left, left_sums), (right, right_sums)]
        return pd.concat(
            [
                pd.DataFrame({"id": ids[at], "own": own[at], "kind": kind, "total": sums[:, j]})
                for at, sums in out
                for j, kind in enumerate(kinds)
            ],
            ignore_index=True,
        )

    parts = tiles.groupBy("lo", "hi").applyInPandas(
        distance_sums, "id bigint, own int, kind int, total double"
    )
    sums = parts.groupBy("id", "own", "kind").agg(F.sum("total").alias("total"))
    size_of = F.create_map(*[F.lit(int(x)) for pair in sizes.items() for x in pair])
    own_size = F.element_at(size_of, F.col("own"))
    mean_own = F.max(F.when(F.col("kind") == F.col("own"), F.try_divide(F.col("total"), own_size - 1)))
    mean_other = F.min(F.when(F.col("kind") != F.col("own"), F.col("total") / F.element_at(size_of, F.col("kind"))))
    per_row = sums.groupBy("id", "own").agg(mean_own.alias("a"), mean_other.alias("b"))
    # a row alone in its cluster has no own distance and scores 0
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per_row.select(F.col("id").alias(row_id), F.col("own").alias(cluster), score.alias("silhouette"))


def silhouette(df: DataFrame, **columns) -> DataFrame:
    """One row `silhouette`: the mean over all rows."""
    return silhouette_rows(df, **columns).agg(F.avg("silhouette").alias("silhouette"))
