"""Run registered queries and compare them with their SQL on DuckDB.

usage: python tests/check_oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of comparable values, columns by name."""
    cols = sorted(df.columns)

    def one(v):
        if v is None or v is pd.NaT or (not isinstance(v, (list, dict)) and pd.api.types.is_scalar(v) and pd.isna(v)):
            return "<null>"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, pd.Timestamp):
            return v.isoformat()
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        try:
            if not isinstance(v, str):
                return repr(float(v))
        except (TypeError, ValueError):
            pass
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(name: str, got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"values differ {sorted(got.columns)}: {diff}"
    ka, kb = kinds(got), kinds(want)
    if ka != kb:
        print(f"     types {name}: {[(c, ka[c], kb[c]) for c in ka if ka[c] != kb[c]]}")
    return None


def main() -> int:
    from shirabe.catalog import SQL, QUERIES
    from shirabe.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    prefixes = tuple(a for a in args if not os.path.isdir(a))
    spark = build_session("oracle", 8)
    con = connect(folder)
    bad = []
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            problem = compare(name, got, con.execute(SQL[name]).df()) if name in SQL else None
        except Exception:
            took, got = time.time() - start, []
            problem = traceback.format_exc(limit=-3)[-900:]
        mark = "FAIL" if problem else ("ok" if name in SQL else "rows")
        print(f"{mark:5}{name:40} {len(got):8} rows {took:6.2f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
