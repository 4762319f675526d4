"""Records of CSV files that are read in splits, although quoted values may hold line breaks.

Lines come from Spark's text source, which cuts a large file into splits at line ends. Whether a line begins inside a quoted
value depends on all lines before it, but a line only maps one answer to another, and such maps can be chained in any
grouping: a first scan chains those of each split, a short table of splits gives the state in which each one begins, and a
second scan puts its lines together. Only records that cross the end of a split are shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_and_read

# what a line does to "a quoted value is open": 2 * (open after it if it was closed before) + (open after it if it was open)
CLOSES, KEEPS, SWAPS, OPENS = range(4)
SUMMARY = pa.schema(
    [("key", pa.int64()), ("block", pa.int64()), ("file", pa.string()), ("kind", pa.int32())]
    + [("if_closed", pa.int64()), ("if_open", pa.int64()), ("header", pa.string())]
)


def _open_after(parts: Column, before: bool) -> Column:
    """Whether a quoted value is open after a line, given its parts between quotes.

    A quote opens a value at the start of a field only, and two of them inside a quoted value are one of its letters; any
    other quote is text.
    """
    shut, ready, inside = F.lit(0), F.lit(1), F.lit(2)
    first = F.element_at(parts, 1)
    begin = inside if before else F.when((first == "") | F.endswith(first, F.lit(",")), ready).otherwise(shut)

    def step(state: Column, part: Column) -> Column:
        again = F.endswith(part, F.lit(",")) | ((state == inside) & (part == ""))
        return F.when(state == ready, inside).when(again, ready).otherwise(shut)

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin, step) == inside


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, block, kind, blank, value, file) of each line: a split is named by its file's key and its first byte."""
    parts = F.split("value", '"', -1)
    kind = F.when(
        F.contains("value", F.lit('"')), _open_after(parts, False).cast("int") * 2 + _open_after(parts, True).cast("int")
    ).otherwise(KEEPS)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select(
        F.xxhash64("file_path").alias("key"),
        F.col("file_block_start").alias("block"),
        kind.cast("tinyint").alias("kind"),
        F.col("value").isin("", "\r").alias("blank"),
        F.make_valid_utf8("value").alias("value"),
        F.col("file_path").alias("file"),
    )


def open_before(kinds: np.ndarray, open_: bool) -> tuple[np.ndarray, bool]:
    """Whether a quoted value is open before each line (or split) of these kinds, and after the last."""
    at = np.arange(len(kinds))
    fixed = np.maximum.accumulate(np.where((kinds == CLOSES) | (kinds == OPENS), at, -1))
    swaps = np.cumsum(kinds == SWAPS)
    base = np.where(fixed >= 0, kinds[fixed] == OPENS, open_)
    after = base ^ ((swaps - np.where(fixed >= 0, swaps[fixed], 0)) % 2 == 1)
    return np.append(open_, after[:-1]).astype(bool), bool(after[-1])


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches cut where a new split begins, with whether one does."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            name = (key[a], block[a])
            yield name != last, batch.slice(a, b - a)
            last = name


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: its kind, the records that begin in it in either state, and the header if it has it."""
    row: dict = {}
    ends, counts, header, wanted = [], [], [], False

    def finish() -> pa.RecordBatch:
        text = "\n".join(header) if row["block"] == 0 else None
        full = {**row, "kind": int(ends[0]) * 2 + int(ends[1]), "if_closed": counts[0], "if_open": counts[1], "header": text}
        return pa.RecordBatch.from_pylist([full], SUMMARY)

    for new, batch in _by_split(batches):
        if new:
            if row:
                yield finish()
            row = {c: batch.column(c)[0].as_py() for c in ("key", "block", "file")}
            ends, counts, header, wanted = [False, True], [0, 0], [], row["block"] == 0
        kinds, blank = batch.column("kind").to_numpy(), batch.column("blank").to_numpy(zero_copy_only=False)
        for i in (0, 1):
            before, ends[i] = open_before(kinds, ends[i])
            counts[i] += int((~before & ~blank).sum())
            if i == 0 and wanted:
                began = np.cumsum(~before & ~blank) + bool(header)
                header += [batch.column("first")[int(k)].as_py() for k in np.flatnonzero((began == 1) & (before | ~blank))]
                wanted = counts[0] < 2
    if row:
        yield finish()


def _placed(splits: pa.Table) -> pa.Table:
    """The splits of a file with the state each one begins in and the records that begin before it."""
    splits = splits.sort_by("block")
    before, _ = open_before(splits["kind"].to_numpy(), False)
    counts = np.where(before, splits["if_open"].to_numpy(), splits["if_closed"].to_numpy())
    first = np.cumsum(counts) - counts
    return pa.table({"key": splits["key"], "block": splits["block"], "open": pa.array(before), "first": pa.array(first)})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and those that cross the end of a split in pieces."""
    open_, number, held, piece, split = False, 0, [], False, None
    out: list[tuple] = []

    def add(whole: bool) -> None:
        out.append((*split, number, whole, "\n".join(held)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["file_rank", "header_id", "block", "number", "whole", "record"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.large_string()]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for new, batch in _by_split(batches):
        if new:
            if held:
                add(whole=not piece and not open_)
            if batch.column("open")[0].as_py() is None:
                raise ValueError("the files were cut otherwise than before: set spark.sql.files.minPartitionNum")
            split = tuple(batch.column(c)[0].as_py() for c in ("file_rank", "header_id", "block"))
            open_ = batch.column("open")[0].as_py()
            number, held, piece = batch.column("first")[0].as_py() - 1, [], True
            returns = batch.column("returns")[0].as_py()
        kinds, blank = batch.column("kind").to_numpy(), batch.column("blank").to_numpy(zero_copy_only=False)
        lines = batch.column("value").to_pylist()
        if returns:
            lines = [x.removesuffix("\r") for x in lines]
        before, open_ = open_before(kinds, open_)
        for line, inside, skip in zip(lines, before.tolist(), blank.tolist(), strict=True):
            if inside:
                held.append(line)
            elif not skip:
                if held:
                    add(whole=not piece)
                number, held, piece = number + 1, [line], False
        if len(out) >= 1_000:
            yield batch_of(out)
            out = []
    if held:
        add(whole=not piece and not open_)
    if out:
        yield batch_of(out)


def column_names(header: str) -> list[str]:
    """Names of the columns; a nameless one is named by its place, one of several equal ones also."""
    names = next(csv.reader([header.removeprefix("﻿")]))
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]], list[tuple[str, int]]]:
    """(records, headers, other files) of all CSV files under `path`.

    `records` has file_rank, the file's place in the order of names, header_id, its header's place in `headers`, number,
    the record's place in the file from 0, and its text. Lines end with LF or CRLF, as the first line of the file does; files
    with lone CRs in their header are returned as (file, file_rank). Blank lines outside quotes are no records. Work is done
    on the call: the files are scanned twice and the records written to the shared folder. The table of splits is sent to
    all tasks, some 50 bytes for each split; names of files and headers go through the driver.
    """
    lines = _lines(spark, path)
    first = F.when(F.col("block") == 0, F.col("value")).alias("first")
    summaries = lines.select("key", "block", "kind", "blank", "file", first).mapInArrow(
        _summaries, "key long, block long, file string, kind int, if_closed long, if_open long, header string"
    )
    splits = write_and_read(summaries, "csv-splits")
    found = sorted(splits.where("block = 0").select("file", "key", "header").collect(), key=lambda r: unquote(r["file"]))
    if len({r["key"] for r in found}) < len(found):
        raise ValueError("two file names have the same hash")
    headers, files, others = [], [], []
    for rank, r in enumerate(found):
        returns = r["header"].endswith("\r")
        text = r["header"].replace("\r\n", "\n").removesuffix("\r") if returns else r["header"]
        if "\r" in text:
            others.append((unquote(r["file"]), rank))
        elif text:
            names = column_names(text)
            if names not in headers:
                headers.append(names)
            files.append((r["key"], rank, headers.index(names), returns))
    known = spark.createDataFrame(files, "key long, file_rank long, header_id int, returns boolean")
    placed = splits.select("key", "block", "kind", "if_closed", "if_open").groupBy("key").applyInArrow(
        _placed, "key long, block long, open boolean, first long"
    )
    table = placed.join(F.broadcast(known), "key")
    # lines keep their order, as the join streams them past a table with one row for each split
    joined = lines.drop("file").join(F.broadcast(table), ["key", "block"], "left")
    left_out = {r["key"] for r in found} - {f[0] for f in files}
    if left_out:
        joined = joined.where(~F.col("key").isin(*left_out))
    pieces = write_and_read(
        joined.mapInArrow(
            _records, "file_rank long, header_id int, block long, number long, whole boolean, record string"
        ),
        "csv-records",
    )
    cut = pieces.where("NOT whole").groupBy("file_rank", "header_id", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("cut")
    )
    mended = cut.select("file_rank", "header_id", "number", F.array_join("cut.record", "\n").alias("record"))
    records = pieces.where("whole").select(*mended.columns).unionByName(mended)
    # the header is the first record
    return records.where("number > 0").withColumn("number", F.col("number") - 1), headers, others
