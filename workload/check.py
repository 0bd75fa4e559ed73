"""Run registered queries beside their SQL in DuckDB and compare the results value by value."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

SOURCE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def _canonical(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(query, spark, con, base: str) -> tuple[str, float]:
    """("ok" | "rows only" | a description of the difference, seconds in Spark)."""
    start = time.time()
    df = query(spark, base)
    rows = df.collect()
    took = time.time() - start
    if query.sql is None:
        return ("rows only" if rows else "EMPTY"), took
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    want_cols, want = _canonical(names, result.fetchall())
    got_cols, got = _canonical(df.columns, rows)
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}", took
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}", took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}", took
    if not got:
        return "ok (no rows)", took
    spark_types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    mismatch = [
        (n, s, t) for (n, s), t in ((d, dict(zip(names, types))[d[0]]) for d in df.dtypes)
        if spark_types.get(s, s) != t.upper()
    ]
    return ("ok" if not mismatch else f"ok, but types {mismatch}"), took


def main(argv: list[str]) -> int:
    import workload.queries  # noqa: F401  registers everything
    from shelfcast.session import build_session
    from workload.registry import QUERIES

    base = argv[0]
    names = argv[1:] or list(QUERIES)
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(base)
    failed = 0
    for name in names:
        try:
            verdict, took = compare(QUERIES[name], spark, con, base)
        except Exception as err:  # noqa: BLE001  report and go on
            verdict, took = f"ERROR {type(err).__name__}: {str(err)[:1500]}", 0.0
        good = verdict.startswith(("ok", "rows only"))
        failed += not good
        print(f"{name:34s} {took:7.2f}s  {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
