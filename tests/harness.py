"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/harness.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r)
    )


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
}


def compare(df, con, sql):
    """None when equal, else a text that says what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]) for d in cursor.description]
    want = cursor.fetchall()
    got = [tuple(r) for r in df.collect()]
    types = dict(df.dtypes)
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of(names, want)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"row {x} != {y}"
    off = [
        (n, types[n], k) for n, k in zip(names, kinds) if KINDS.get(k, k) != types[n].replace("_ntz", "")
    ]
    return f"types {off}" if off else None


def main(argv):
    import __spark_entry__ as entry
    from keelson.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": os.environ.get("CHECK_PARTITIONS", "8"), "spark.driver.memory": "8g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    if argv == ["--sql-only"]:
        argv = list(oracles)
    names = [n for n in queries if not argv or n in argv or any(a.endswith("*") and n.startswith(a[:-1]) for a in argv)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                note = compare(df, con, oracles[name])
                count = ""
            else:
                count = f"{df.count()} rows only"
                note = None
        except Exception as exc:  # report and go on
            note, count = f"{type(exc).__name__}: {str(exc)[:900]}", ""
        took = time.time() - start
        bad += note is not None
        print(f"{'FAIL' if note else 'ok  '} {name:26s} {took:6.2f}s {count} {note or ''}", flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
