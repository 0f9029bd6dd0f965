"""Compare every registered query with its SQL. Usage: oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as registered  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_KINDS = {"boolean": "BOOLEAN", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cells(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if pd.isna(value) else value for value in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def compare(spark: SparkSession, connection, name: str, sf_dir: str) -> str | None:
    """None when query and SQL agree, else what differs."""
    frame = registered.queries()[name](spark, sf_dir)
    sql = registered.oracle_sql()[name]
    described = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    types = {column: _KINDS.get(kind, kind) for column, kind in frame.dtypes}
    if types != described:
        return f"schema: {types} / {described}"
    got = _cells(pd.DataFrame(frame.collect(), columns=frame.columns, dtype=object))
    wanted_cursor = connection.execute(sql)
    names = [d[0] for d in wanted_cursor.description]
    wanted = _cells(pd.DataFrame(wanted_cursor.fetchall(), columns=names, dtype=object))
    if len(got) != len(wanted):
        return f"rows: {len(got)} / {len(wanted)}"
    for left, right in zip(got, wanted):
        if left != right:
            return f"values:\n  {left}\n  {right}"
    return None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(registered.oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "/tmp/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"error: {str(error)[:800]}"
        failed += problem is not None
        print(f"{name}: {problem or 'equal'} ({time.time() - started:.1f}s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
