"""Run registered queries against their comparison SQL and report differences.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
DATA = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def canon(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def kinds(columns, rows):
    """Python type per column, to catch numbers that one side returns in another type."""
    found = {}
    for r in rows:
        for c, v in zip(columns, r):
            if v is not None and c not in found:
                found[c] = type(v).__name__
        if len(found) == len(columns):
            break
    return found


def compare(con, sql, df) -> tuple[str, int]:
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "rows-only", len(got)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"rows differ {len(a)} vs {len(b)} ({sorted(names)})\n   spark {only_a}\n   sql   {only_b}", len(got)
    ka, kb = kinds(df.columns, got), kinds(names, want)
    if ka != kb:
        return f"types differ { {c: (ka.get(c), kb.get(c)) for c in names if ka.get(c) != kb.get(c)} }", len(got)
    return "ok", len(got)


def main() -> int:
    import __spark_entry__ as entry
    from inferbatch.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8)
    con = connect(args.sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t = time.time()
        try:
            verdict, n = compare(con, sqls.get(name), build(spark, str(DATA / f"sf{args.sf}")))
        except Exception as e:  # report and go on with the next query
            verdict, n = f"error {type(e).__name__}: {str(e)[:700]}", -1
        flag = "" if verdict in ("ok", "rows-only") else "!! "
        empty = " EMPTY" if n == 0 else ""
        bad += bool(flag)
        print(f"{flag}{name}: {verdict} ({n} rows{empty}, {time.time() - t:.1f}s)", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
