"""Compares registered queries with their SQL counterparts (python tests/oracle_check.py [sf] [name…])."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, int):
        return (2, str(v))
    if isinstance(v, float):
        return (3, "nan" if v != v else repr(v + 0.0))
    return (4, f"{type(v).__name__}:{v}")


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str, inspect=None):
    """Returns (rows, error text or None); ``inspect`` is called with the frame before it runs."""
    df = fn(spark, sf_dir)
    if inspect is not None:
        inspect(df)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return len(got), f"columns {cols} vs {sorted(names)}"
    pick = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in pick) for r in res.fetchall())
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}; {got[:1]} {want[:1]}"
    for g, w in zip(got, want):
        if g != w:
            return len(got), f"value\n     spark {dict(zip(cols, g))}\n       sql {dict(zip(cols, w))}"
    return len(got), None


def main() -> int:
    from tidemark import registry
    from tidemark.session import local_session

    registry.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(registry.JOBS)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            rows, err = compare(spark, con, name, registry.JOBS[name], registry.ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            rows, err = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if name in registry.ORACLES else "rows"
        if err:
            bad += 1
        if err or "-v" in os.environ.get("CHECK", "-v"):
            print(f"{'FAIL' if err else 'ok  '} {kind} {name:24s} {rows:8d} rows {time.time() - start:6.2f}s {err or ''}",
                  flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
