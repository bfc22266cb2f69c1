"""Compares registered queries with their SQL. `python tests/compare.py SF_DIR [names]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    return str(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns and the same rows, else what differs."""
    spark_rows = [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    rows = result.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = canonical(spark_df.columns, spark_rows), canonical(names, rows)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"


if __name__ == "__main__":
    from pixelmill.session import build
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sys.argv[1])
    failed = []
    for name in sys.argv[2:] or [n for n in QUERIES if n in ORACLE]:
        start = time.time()
        try:
            problem = difference(QUERIES[name](spark, sys.argv[1]), con, ORACLE[name])
        except Exception as error:
            problem = f"error {str(error)[:500]}"
        if problem:
            failed.append(name)
        print(f"{name:26s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)
    print("failed:", failed)
