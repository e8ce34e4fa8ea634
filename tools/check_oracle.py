"""Run named queries on Spark and their SQL on DuckDB and compare rows, types and values.

    python tools/check_oracle.py [-s SF] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalize(table) -> pd.DataFrame:
    """Columns by name, values as comparable text, rows sorted."""
    names = sorted(table.column_names)
    out = pd.DataFrame({n: [_text(v) for v in table.column(n).to_pylist()] for n in names})
    return out.sort_values(names).reset_index(drop=True) if names else out


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return str(v)


def kinds(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "").replace("[us]", "") for f in table.schema}


def compare(spark, con, name: str, sf_dir: str, may_be_empty: bool = False) -> str | None:
    """None if both sides agree, else what differs."""
    from panelspark.registry import ORACLE, QUERIES

    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLE:
        return None if got.num_rows or may_be_empty else "no rows"
    want = con.sql(ORACLE[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} != {want.num_rows}"
    if not got.num_rows:
        return None if may_be_empty else "no rows"
    g, w = normalize(got), normalize(want)
    if not g.equals(w):
        bad = [c for c in g if not g[c].equals(w[c])]
        i = next(i for i in range(len(g)) if list(g.iloc[i]) != list(w.iloc[i]))
        return f"values differ in {bad}: row {i} {dict(g[bad].iloc[i])} != {dict(w[bad].iloc[i])}"
    if kinds(got) != kinds(want):
        a, b = kinds(got), kinds(want)
        return f"types { {k: (a[k], b[k]) for k in a if a[k] != b[k]} }"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from panelspark import registry
    from panelspark.session import build_session

    registry.load_all()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in args.names or registry.QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        kind = "sql" if name in registry.ORACLE else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
