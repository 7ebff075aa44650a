"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python check_queries.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb

from lexigrid.catalog import ORACLES, QUERIES
from lexigrid.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.monotonic()
    found = QUERIES[name](spark, sf_dir)
    ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
    took = time.monotonic() - started
    if name not in ORACLES:
        return True, f"{sum(ours.values())} rows, no SQL, {took:.1f} s"
    started = time.monotonic()
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    note = f"{sum(ours.values())} rows, {took:.1f} s, SQL {time.monotonic() - started:.1f} s"
    if sorted(columns) != sorted(found.columns):
        return False, f"columns {sorted(found.columns)} and {sorted(columns)}"
    if ours != theirs:
        return False, (
            f"{note}; {sum(theirs.values())} rows in SQL; only here {list((ours - theirs).items())[:2]};"
            f" only there {list((theirs - ours).items())[:2]}"
        )
    return True, note


def connect(sf_dir: str):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, connection = local_session(int(__import__("os").environ.get("BENCH_CPUS", "8"))), connect(sf_dir)
    bad = 0
    for name in args.names or QUERIES:
        try:
            good, note = compare(spark, connection, sf_dir, name)
        except Exception as error:  # keep going, report at the end
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "BAD ", name, note[:1200], flush=True)
    print(f"{bad} bad")
    raise SystemExit(bad > 0)


if __name__ == "__main__":
    main()
