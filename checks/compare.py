"""Run queries and their DuckDB statements side by side: python -m checks.compare SF [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main(sf: str, names: list[str]) -> int:
    from checks import ORACLES, QUERIES

    spark = local_session("compare")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, df.collect())
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        spent = time.time() - started
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows, {spent:.1f}s", flush=True)
            continue
        try:
            result = con.sql(ORACLES[name])
            columns = list(result.columns)
            want = rows_of(columns, result.fetchall())
        except Exception as error:
            print(f"SQLERR {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        if sorted(columns) != sorted(df.columns):
            print(f"NAMES {name}: {sorted(df.columns)} vs {sorted(columns)}")
            bad += 1
        elif got != want:
            bad += 1
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; columns {sorted(columns)}")
            mine, theirs = set(got), set(want)
            for row in sorted(mine - theirs)[:3]:
                print("   spark ", row)
            for row in sorted(theirs - mine)[:3]:
                print("   duckdb", row)
        else:
            print(f"ok    {name}: {len(got)} rows, {spent:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
