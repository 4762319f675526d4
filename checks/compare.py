"""Run the registered queries next to their SQL and compare: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from mailsift.session import build_session

from .oracle import ORACLE
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(frame) -> list:
    """Rows with columns in name order, sorted, missing values alike."""

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "\0"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    columns = sorted(frame[0])
    index = [frame[0].index(c) for c in columns]
    return [tuple(columns), *sorted(tuple(cell(row[i]) for i in index) for row in frame[1])]


def main(sf: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = build_session(master="local[8]", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            ours = rows_of((df.columns, [tuple(r) for r in df.collect()]))
        except Exception as error:  # a report of every query is wanted
            print(f"FAIL {name}: {str(error)[:600]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows {name}: {len(ours) - 1} rows, {took:.1f} s", flush=True)
            continue
        start = time.time()
        try:
            result = con.execute(ORACLE[name])
            theirs = rows_of(([c[0] for c in result.description], result.fetchall()))
        except Exception as error:
            print(f"SQL  {name}: {str(error)[:400]}", flush=True)
            bad += 1
            continue
        same = ours == theirs
        print(
            f"{'ok  ' if same else 'DIFF'} {name}: {len(ours) - 1} rows, {took:.1f} s, sql {time.time() - start:.1f} s",
            flush=True,
        )
        if not same:
            bad += 1
            print("   columns", ours[0], theirs[0], "rows", len(theirs) - 1)
            for a, b in [(a, b) for a, b in zip(ours[1:], theirs[1:]) if a != b][:3]:
                print("   spark", str(a)[:300], "\n   sql  ", str(b)[:300])
    print("differences or failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
