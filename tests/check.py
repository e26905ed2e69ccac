"""Compare every query with its SQL: ``python -m tests.check [folder] [name …]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from tamiz.queries import QUERIES, SQL


# All pairs of rows, and Python called row by row.
UNWANTED = ["CartesianProduct", "NestedLoopJoin", "BatchEvalPython"]


def database(folder: str):
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    return None if value != value else value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, db, folder: str, name: str) -> tuple[int, str]:
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    unwanted = [node for node in UNWANTED if node in plan]
    if unwanted:
        return -1, f"plan has {unwanted}"
    got = as_rows(df.columns, df.collect())
    if name not in SQL:
        return sum(got[1].values()), "rows only"
    done = db.execute(SQL[name])
    want = as_rows([c[0] for c in done.description], done.fetchall())
    if got == want:
        return sum(got[1].values()), "ok"
    extra, absent = got[1] - want[1], want[1] - got[1]
    return sum(got[1].values()), (
        f"DIFFERENT columns {got[0] == want[0]} {got[0] if got[0] != want[0] else ''} {want[0] if got[0] != want[0] else ''} "
        f"only spark {sum(extra.values())}: {list(extra)[:2]} only sql {sum(absent.values())}: {list(absent)[:2]}"
    )


def main(folder="/root/testdata/sf0.01", *names):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = database(folder)
    for name in names or QUERIES:
        start = time.time()
        try:
            rows, verdict = compare(spark, db, folder, name)
        except Exception as e:  # a failing query must not hide the others
            rows, verdict = -1, f"FAILED {type(e).__name__}: {str(e)[:700]}"
        print(f"{name:34s} {rows:8d} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
