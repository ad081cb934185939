"""Run a registered query and its DuckDB SQL on the same tables and compare the rows.

Command line: python tests/oracle.py [scale] [name part ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, (dt.datetime, dt.date)):
        return type(value).__name__
    return "str" if isinstance(value, str) else type(value).__name__


def compare(spark, con, name: str, folder: str) -> tuple[str, int]:
    """"ok" or a description of the first difference, and the row count."""
    from parchline.workloads import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in ORACLES:
        return "rows only", len(mine)
    cur = con.execute(ORACLES[name])
    found = [d[0] for d in cur.description]
    if sorted(found) != columns:
        return f"columns differ: {columns} / {sorted(found)}", len(mine)
    order = [found.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}", len(mine)
    for at, column in enumerate(columns):
        a, b = ({kind(r[at]) for r in rows if r[at] is not None} for rows in (mine, theirs))
        if a and b and a != b:
            return f"types of {column} differ: {a} / {b}", len(mine)
    key = repr
    left, right = sorted(map(key, mine)), sorted(map(key, theirs))
    if left != right:
        extra = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        bad = len(set(left) - set(right))
        return f"{bad} rows differ, e.g. {columns}: {extra[0]} / {extra[1]}", len(mine)
    return "ok", len(mine)


def main() -> int:
    from parchline.session import local_session
    from parchline.workloads import QUERIES

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    con = connect(folder)
    failures = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            result, rows = compare(spark, con, name, folder)
        except Exception as problem:  # noqa: BLE001
            result, rows = f"{type(problem).__name__}: {str(problem)[:1500]}", -1
        bad = result not in ("ok", "rows only")
        failures += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:34s} rows={rows:<7d} {time.time() - began:6.2f}s {result if result != 'ok' else ''}", flush=True)
    print(f"failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(main())
