"""Run registered queries and their SQL on the same tables and compare the rows. ``compare.py DIR [NAME ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(item) for item in value)
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    shaped = [tuple(plain(row[place]) for place in order) for row in rows]
    return [columns[place] for place in order], sorted(shaped, key=repr)


def check(spark, connection, sf_dir: str, name: str, queries, oracle) -> str | None:
    """None where both agree, else what differs."""
    result = queries[name](spark, sf_dir)
    got_columns, got = normalized(result.columns, [tuple(row) for row in result.collect()])
    answer = connection.execute(oracle[name])
    want_columns, want = normalized([item[0] for item in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = [row for row in got if row not in set(want)][:2]
        missing = [row for row in want if row not in set(got)][:2]
        columns = {
            name
            for one, two in zip(got, want)
            for name, left, right in zip(got_columns, one, two)
            if left != right
        }
        return f"{len(got)} rows != {len(want)} rows, {columns}\n   extra {extra}\n   missing {missing}"
    return None if got else "no rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from folioscope.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    found, oracle = queries(), oracle_sql()
    print("without SQL:", sorted(set(found) - set(oracle)), "SQL only:", sorted(set(oracle) - set(found)))
    bad = 0
    for name in names or oracle:
        started = time.time()
        try:
            problem = check(spark, connection, sf_dir, name, found, oracle)
        except Exception:
            problem = traceback.format_exc(limit=3)[-1500:]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
