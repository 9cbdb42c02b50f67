"""Run the registered queries next to their SQL and report differences.

``python -m checks.compare <sf_dir> [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import QUERIES
from checks.sql import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    """One spelling for values both engines may type differently."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return round(float(value), 6) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if name not in ORACLES:
        return f"rows  {len(got)} ({took:.1f}s)"
    t = time.time()
    result = con.execute(ORACLES[name])
    want_columns, want = rows_of([c[0] for c in result.description], result.fetchall())
    took = f"spark {took:.1f}s sql {time.time() - t:.1f}s"
    if got_columns != want_columns:
        return f"COLUMNS {sorted(set(got_columns) ^ set(want_columns))}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"DIFF {len(got)} vs {len(want)}\n   spark {str(only_got)[:900]}\n   sql   {str(only_want)[:900]}"
    return f"ok    {len(got)} ({took})"


if __name__ == "__main__":
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for query_name in names:
        try:
            print(f"{query_name:26s}", compare(session, connection, folder, query_name), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{query_name:26s} FAIL {str(e)[:500]}", flush=True)
