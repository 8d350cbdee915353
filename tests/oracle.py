"""Compares a registered query with its SQL on the same parquet files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from folioflow.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def compare(spark, con, folder: str, name: str) -> list[str]:
    """Differences between query and SQL; empty when they agree."""
    got = entry_points.queries()[name](spark, folder).toPandas()
    want = con.sql(entry_points.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    problems = []
    for c in got.columns:
        kinds = got[c].dtype.kind, want[c].dtype.kind
        if kinds[0] != kinds[1] and len(got):
            problems.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
    a, b = canonical(got), canonical(want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lacking = [r for r in b if r not in set(a)][:2]
        problems.append(f"{len(a)} rows != {len(b)} rows; only here {extra}; only in SQL {lacking}")
    if not len(got):
        problems.append("no rows")
    return problems


def main() -> None:
    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(entry_points.queries())
    spark, con = build_session("8"), duck(folder)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            if name in entry_points.oracle_sql():
                problems = compare(spark, con, folder, name)
            else:
                n = len(entry_points.queries()[name](spark, folder).toPandas())
                problems = [] if n else ["no rows"]
                name += f" (rows only: {n})"
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {time.time() - start:6.2f}s {name}", flush=True)
        for p in problems:
            print("       ", p[:1500], flush=True)
    print(f"{failed} of {len(wanted)} failed")


if __name__ == "__main__":
    main()
