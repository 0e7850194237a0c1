"""Runs a query in Spark and its SQL twin in DuckDB and compares the rows.

    python -m workload.compare [sf_dir] [key…]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workload import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cores: int | str = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("featwright")
        .config("spark.sql.shuffle.partitions", "8")
        # the test tables are small but costly per row: keep all cores busy
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return str(value)


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(spark: SparkSession, con, key: str, sf_dir: str) -> tuple[str | None, int, float]:
    """What differs (None if nothing), the row count and Spark's seconds."""
    start = time.time()
    df = registry.queries()[key](spark, sf_dir)
    collected = df.collect()
    seconds = time.time() - start
    sql = registry.oracle_sql().get(key)
    if sql is None:
        return (None if collected else "no rows"), len(collected), seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(collected), seconds
    ours, theirs = _rows(df.columns, collected), _rows(names, expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}", len(collected), seconds
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}", len(collected), seconds
    return (None if ours else "no rows"), len(collected), seconds


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(registry.queries())
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for key in keys:
        try:
            message, n, seconds = differences(spark, con, key, sf_dir)
        except Exception as error:  # keep going: one report for all keys
            message, n, seconds = f"{type(error).__name__}: {str(error)[:1200]}", 0, 0.0
        failed += message is not None
        oracle = "sql" if key in registry.oracle_sql() else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {key} [{oracle}] {n} rows {seconds:.1f}s {message or ''}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
