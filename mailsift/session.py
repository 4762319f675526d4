"""Session settings, and the helpers that look at them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "mailsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects; `conf` wins over them.

    Shuffle partitions are left to the cluster unless the master is local. Adaptive execution merges small ones but
    makes no more, so on large inputs set them to the bytes shuffled over some 128 MB. The heap is the caller's.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is made only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = getattr(shared_folder, "local", None)
        if folder is None:
            folder = shared_folder.local = tempfile.mkdtemp(prefix="mailsift-")
    if spark.sparkContext.getCheckpointDir() is None:
        # the boosted trees checkpoint their own lineage when this is set
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run inside go when each ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a written table in the shared folder, so that lost executors cost no recomputation."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than the cluster has cores, as text work is CPU-bound.

    Only for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def side_by_side(spark: SparkSession, jobs: Iterable[Callable], width: int = 4) -> list:
    """Results of independent Spark jobs, submitted from a few threads so that small ones share the cluster."""
    pool = ThreadPool(width)
    try:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)
    finally:
        pool.close()
