"""Compare queries with their SQL: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from shelfcast.session import build_session  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def same(left: pd.DataFrame, right: pd.DataFrame) -> str:
    """Empty when both hold the same rows, in whatever order."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    columns = sorted(left.columns)
    if not len(left):
        return ""
    a, b = (
        pd.DataFrame({c: _plain(df[c]) for c in columns}).sort_values(columns, ignore_index=True)
        for df in (left, right)
    )
    differs = (a != b).any(axis=1)
    if not differs.any():
        return ""
    bad = differs.idxmax()
    return f"{differs.sum()} rows differ, e.g.\n  {a.loc[bad].to_dict()}\n  {b.loc[bad].to_dict()}"


def _plain(column: pd.Series) -> pd.Series:
    """Numbers as doubles, everything else as text; nulls become a value of their own."""
    known = column.dropna()
    if len(known) and pd.api.types.is_bool_dtype(known.infer_objects().dtype):
        return column.astype(object).where(column.notna(), "null").astype(str)
    if not len(known) or pd.api.types.is_numeric_dtype(known.infer_objects().dtype):
        return pd.to_numeric(column, errors="coerce").astype("float64").fillna(-9.87654321e300) + 0.0
    if pd.api.types.is_datetime64_any_dtype(column.dtype) or hasattr(known.iloc[0], "isoformat"):
        return pd.to_datetime(column).dt.strftime("%Y-%m-%d").fillna("null")
    return column.astype(object).where(column.notna(), "null").astype(str)


def _kind(name: str) -> str:
    name = str(name).lower()
    return {"integer": "int", "varchar": "string"}.get(name, name)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = build_session(8), connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            result = entry.queries()[name](spark, folder)
            types = dict(result.dtypes)
            left = result.toPandas()
            spark_sec = time.time() - start
            if name not in entry.oracle_sql():
                print(f"rows {name} {len(left)} {spark_sec:.1f}s", flush=True)
                continue
            relation = con.sql(entry.oracle_sql()[name])
            other = {c: _kind(t) for c, t in zip(relation.columns, relation.types)}
            right = relation.df()
            problem = same(left, right)
            kinds = {c: (t, other.get(c)) for c, t in types.items() if _kind(t) != other.get(c)}
            if kinds:
                problem += f" types {kinds}"
        except Exception as error:  # report every query, not the first failure only
            problem, spark_sec, left = f"{type(error).__name__}: {str(error)[:1500]}", 0, []
        print(f"{'FAIL' if problem else 'ok'} {name} {len(left)} spark {spark_sec:.1f}s "
              f"all {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(len(names) - len(failed), "of", len(names), "ok; failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
