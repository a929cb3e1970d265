"""Compare registered queries with their SQL forms: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(value):
    if isinstance(value, list):
        return tuple(map(_value, value))
    if isinstance(value, float):
        return ("float", "nan" if value != value else repr(value))
    if isinstance(value, dict):
        return tuple(sorted((k, _value(v)) for k, v in value.items()))
    return (type(value).__name__, value)


def compare(spark, con, run, sql: str, sf_dir: str) -> tuple[str, float, float]:
    """``''`` when both give the same columns and rows, else what differs; with both times."""
    start = time.time()
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(_value(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    spark_time = time.time() - start
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    picks = [names.index(c) for c in sorted(names)]
    theirs = Counter(tuple(_value(row[i]) for i in picks) for row in cursor.fetchall())
    sql_time = time.time() - start
    if columns != sorted(names):
        return f"columns {columns} != {sorted(names)}", spark_time, sql_time
    if ours != theirs:
        only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return (
            f"rows {sum(ours.values())} vs {sum(theirs.values())}, differing {sum((ours - theirs).values())}\n"
            f"   ours   {only_ours}\n   theirs {only_theirs}",
            spark_time,
            sql_time,
        )
    return ("" if ours else "no rows"), spark_time, sql_time


def main() -> None:
    from tablewright.queries import load
    from tablewright.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, registry = local_session(), duck(sf_dir), load()
    names = sys.argv[2:] or list(registry)
    bad = 0
    for name in names:
        registered = registry[name]
        try:
            if registered.sql is None:
                start = time.time()
                result, ours, theirs = "", None, 0.0
                rows = registered.run(spark, sf_dir).collect()
                ours = time.time() - start
                print(f"rows-only {name} {len(rows)} rows {ours:.2f}s", rows[:2], flush=True)
                continue
            result, ours, theirs = compare(spark, con, registered.run, registered.sql, sf_dir)
        except Exception as error:  # report every query, whatever one of them does
            result, ours, theirs = f"{type(error).__name__}: {str(error)[:1500]}", 0.0, 0.0
        bad += bool(result)
        print(f"{'FAIL' if result else 'ok  '} {name} spark {ours:.2f}s duck {theirs:.2f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
