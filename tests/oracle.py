"""Compare every query with its SQL on DuckDB.  Usage: oracle.py [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def compare(spark, con, folder: str, make, sql: str) -> str | None:
    """None when both give the same rows; otherwise what differs."""
    mine = make(spark, folder)
    names = sorted(mine.columns)
    got = [tuple(_plain(v) for v in r) for r in mine.select(*[f"`{n}`" for n in names]).collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    at = [columns.index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in at) for r in cursor.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    if not got:
        return "no rows"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {names}: {bad[0][0]} against {bad[0][1]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(queries())
    spark, con = build_session(), connect(folder)
    failed = 0
    for name in wanted:
        began = time.perf_counter()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, folder, queries()[name], oracle_sql()[name])
            else:
                problem = None if queries()[name](spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.perf_counter() - began
        kind = "same" if name in oracle_sql() else "rows"
        print(f"{kind if problem is None else 'FAIL':5} {took:6.1f}s {name} {problem or ''}", flush=True)
        failed += problem is not None
    print(f"{len(wanted) - failed} of {len(wanted)} good")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
