"""Runs queries and their SQL side by side and compares rows: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from millrace.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def sorted_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda column: column.map(lambda value: "" if pd.isna(value) else str(value)))
    return text.sort_values(list(text.columns), ignore_index=True)


def differences(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> str:
    """Empty when both hold the same rows in any order; else what differs."""
    if sorted(spark_rows.columns) != sorted(oracle_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(oracle_rows.columns)}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} and {len(oracle_rows)} rows"
    ours, theirs = sorted_rows(spark_rows), sorted_rows(oracle_rows)
    for column in ours.columns:
        unequal = ours[column] != theirs[column]
        if unequal.any():
            first = unequal.idxmax()
            return f"{column}: {ours[column][first]!r} and {theirs[column][first]!r}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions="8",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.perf_counter()
        try:
            rows = QUERIES[name](spark, sf_dir).toPandas()
            problem = differences(rows, connection.execute(ORACLE[name]).df())
        except Exception as error:
            rows, problem = [], f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {len(rows):7} rows {time.perf_counter() - start:6.2f} s {problem}")
    print(f"{failed} of {len(names or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(bool(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:])))
