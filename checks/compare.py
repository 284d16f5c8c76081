"""Run registered queries against their oracles: ``python -m checks.compare [sf folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else ("f", value + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return (type(value).__name__, str(value))


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> tuple[bool, str, float]:
    start = time.time()
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows {got_columns}", seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_columns, want = rows_of(names, cursor.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} vs {want_columns}", seconds
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}: {got[:2]} vs {want[:2]}", seconds
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; columns {got_columns}\n   {bad[0][0]}\n   {bad[0][1]}", seconds
    return True, f"{len(got)} rows equal", seconds


def main() -> int:
    import importlib

    from statloom.session import local_session

    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    folder = args[0] if args else "/root/testdata/sf0.01"
    entry = importlib.import_module("__spark_entry__")
    spark = local_session()
    con = connect(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if len(args) > 1 and not any(name.startswith(a) for a in args[1:]):
            continue
        try:
            ok, note, seconds = compare(spark, con, folder, name, query, oracles.get(name))
        except Exception as e:
            ok, note, seconds = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {seconds:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
