"""Membership flags against lookup lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
MIN_SALTS = 32


def flag_members(
    df: DataFrame,
    key: str,
    listed: DataFrame,
    listed_column: str,
    flag: str,
    row_id: str = "email_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add `flag`: 1 when `key` is on the list, else 0. The match is exact and case-sensitive; NULL gives 0.

    A list measured to be small is broadcast. A larger one is joined by shuffle on (key, salt) with one copy of
    the list per salt, so that a sender domain that holds a third of all mail spreads over many tasks. Rows
    without a key match nothing, so they may spread over all of them.
    """
    names = listed.select(F.col(listed_column).alias("__listed")).where("__listed IS NOT NULL").distinct()
    hit = F.col("__listed").isNotNull().cast("int").alias(flag)
    kept = [c for c in df.columns if c != flag]
    size = names.limit(broadcast_rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length("__listed"))).first()
    if size[0] <= broadcast_rows and (size[1] or 0) <= BROADCAST_BYTES:
        found = df.join(F.broadcast(names), F.col(key) == F.col("__listed"), "left")
        return found.select(*kept, hit)
    salts = max(MIN_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    spot = F.xxhash64(row_id)
    salted = df.withColumn("__salt", F.when(F.col(key).isNull(), spot).otherwise(F.pmod(spot, F.lit(salts))))
    copies = names.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    found = salted.join(copies, (F.col(key) == F.col("__listed")) & (F.col("__salt") == F.col("__copy")), "left")
    return found.select(*kept, hit)
