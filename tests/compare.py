"""Run registered queries and their oracles side by side.

    python tests/compare.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) and v == 0:
            return 0.0
        return v

    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns and the same multiset of rows."""
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns differ: {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)}, duckdb {len(want)}"
    a, b = canonical(got_cols, got), canonical(want_cols, want)
    for x, y in zip(a, b):
        if x != y:
            bad = sum(1 for p, q in zip(a, b) if p != q)
            return f"{bad} of {len(a)} rows differ, first ({sorted(got_cols)}):\n  spark  {x}\n  duckdb {y}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    from __spark_entry__ import oracle_sql, queries
    from basketflow.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    qs, oracles, failed = queries(), oracle_sql(), 0
    for key in args.keys or qs:
        start = time.time()
        try:
            df = qs[key](spark, sf_dir)
            if key in oracles:
                message = difference(df, con, oracles[key])
                n = con.execute(f"SELECT count(*) FROM ({oracles[key]})").fetchone()[0]
            else:
                message, n = None, df.count()
            state = "ok  " if message is None else "FAIL"
            if key not in oracles:
                state = "rows"
        except Exception as exc:  # report and go on with the next key
            state, message, n = "FAIL", f"{type(exc).__name__}: {str(exc)[:600]}", -1
        failed += state == "FAIL"
        print(f"{state} {key:22s} rows={n:<8d} {time.time() - start:6.2f}s {message or ''}", flush=True)
    print("failed:", failed)
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
