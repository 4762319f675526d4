"""Reading and writing email tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import null_to_sentinel
from .records import read_records

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
# ids of one file lie below this, so that a file's rank and a row's place give an id
ROWS_PER_FILE = 1 << 36


def _all_text_csv(spark: SparkSession, path: str | list[str], header: list[str] | None = None) -> DataFrame:
    """CSV files with every column as text, by header name, and no value taken for missing.

    A file whose header differs from the schema's raises, as values would be taken by position otherwise.
    """
    reader = spark.read.options(**CSV).option("inferSchema", False).option("enforceSchema", False)
    if header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return reader.csv(path).na.fill("")


def _header(spark: SparkSession, file: str) -> list[str]:
    return spark.read.options(**CSV).option("inferSchema", False).csv(file).columns


def read_emails(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Raw or cleaned emails. `email_id` is added when the input has none: files in order of their names, rows in file order.

    Columns go by header name; files may have them in different orders, and a column that a file lacks is empty. Large CSV
    files are read by many tasks, quoted line breaks or not, if they are not compressed; see `records.read_records`. Only a
    file whose lines end with lone CRs is read by one.
    """
    if format == "csv":
        records, headers, others = read_records(spark, path)
        parts = [_parsed(records.where(F.col("header_id") == i), header) for i, header in enumerate(headers)]
        parts += [_one_task(spark, file, rank) for file, rank in others]
        if not parts:
            return _all_text_csv(spark, path).withColumn("email_id", F.monotonically_increasing_id())
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part, allowMissingColumns=True)
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.na.fill("", subset=text)
    elif format == "parquet":
        df = spark.read.parquet(path)
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.na.fill("", subset=text) if text else df
    else:
        raise ValueError(f"unknown format {format!r}")
    if "email_id" in df.columns:
        return df.withColumn("email_id", F.col("email_id").cast("bigint"))
    return df.withColumn("email_id", F.monotonically_increasing_id())


def _parsed(records: DataFrame, header: list[str]) -> DataFrame:
    """Columns of records, all as text, and an id from a record's file and its place there unless there is one."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    parsed = records.withColumn("r", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"'}))
    columns = [F.coalesce(f"r.c{i}", F.lit("")).alias(name) for i, name in enumerate(header)]
    if "email_id" not in header:
        columns.append((F.col("file_rank") * ROWS_PER_FILE + F.col("number")).alias("email_id"))
    return parsed.select(*columns)


def _one_task(spark: SparkSession, file: str, rank: int) -> DataFrame:
    """A file whose lines end otherwise, read by one task."""
    df = _all_text_csv(spark, file, _header(spark, file))
    if "email_id" in df.columns:
        return df
    return df.withColumn("email_id", F.monotonically_increasing_id() % F.lit(1 << 33) + rank * ROWS_PER_FILE)


def read_domain_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a lookup list as (domain): blank entries dropped, each entry once, taken as written."""
    listed = spark.read.options(**CSV).option("inferSchema", False).csv(path)
    return listed.select(F.col(f"`{column}`").alias("domain")).where("domain IS NOT NULL AND domain <> ''").distinct()


def write_clean(df: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Write a table. Parquet keeps NULL; CSV writes it as the text "NaN", with a header and no index, blanks as they are."""
    if format == "parquet":
        df.write.mode(mode).parquet(path)
    elif format == "csv":
        text = {f.name: null_to_sentinel(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
        out = df.withColumns(text) if text else df
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", **blanks).csv(path)
    else:
        raise ValueError(f"unknown format {format!r}")
