"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.session import write_and_read


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the smallest node that can be reached.

    Large and small stars by turns: each node's larger neighbours are tied to its smallest neighbour, then the rest of its
    neighbours and itself, until nothing changes. A round is an aggregate (combined on the map side, so that a hub costs a
    row per task) and a join of the links with it, whose large keys adaptive execution can split. Each round is written
    down, so that lost executors cost no earlier round. The rounds grow with the logarithm of the longest chain.
    """
    larger = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    larger = write_and_read(larger, f"{name}-links")
    seen = None
    while True:
        stars = star(star(larger, large=True), large=False)
        stars = write_and_read(stars, f"{name}-round")
        # a star forest is its own large and small star; both measures below then stay as they are
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())
        larger, seen = stars, now


def star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b, after each node has tied neighbours to the smallest of them and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return tied.where("a <> b").distinct()
