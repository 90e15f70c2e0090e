"""Runs registered queries beside DuckDB: row count, columns, and values in any order.

python tests/compare.py FOLDER [KEY...] prints a line for each query that differs."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v: object) -> object:
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        name, _, _ = f.partition(".")
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(spark, con, query, oracle: str, folder: str) -> str:
    """What differs, or an empty text."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} rows differ, as {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con, bad, done = duck(sys.argv[1]), 0, 0
    oracles = __spark_entry__.oracle_sql()
    for key, fn in __spark_entry__.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:] or not sys.argv[2:] and key.startswith(("op", "pipeline")):
            continue
        try:
            said = difference(session, con, fn, oracles[key], sys.argv[1]) if key in oracles else "" if fn(session, sys.argv[1]).collect() is not None else ""
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:300]}"
        done += 1
        if said:
            bad += 1
            print(key, "|", said.replace("\n", " "), flush=True)
    print(f"{done} queries, {bad} differ")
