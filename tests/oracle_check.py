"""Compare every registered Spark query with its DuckDB statement.

Usable from pytest (:func:`compare`) and as a script::

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    """One comparable text per value: NULL and NaN alike, numpy scalars as Python values."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if hasattr(v, "item"):
        v = v.item()
    return repr(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(rel):
    cols = [d[0] for d in rel.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    data = rel.fetchall()
    return [cols[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, name: str, query, sql: str) -> tuple[bool, str]:
    sdf = query(spark, SF_DIR_HOLDER[0])
    scols, srows = rows_of_spark(sdf)
    dcols, drows = rows_of_duck(con.execute(sql))
    if scols != dcols:
        return False, f"columns differ: spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} duck={len(drows)}"
    if srows != drows:
        diff = next(i for i, (a, b) in enumerate(zip(srows, drows)) if a != b)
        return False, f"values differ at sorted row {diff}: spark={srows[diff][:3]!s:.300} duck={drows[diff][:3]!s:.300}"
    return True, f"{len(srows)} rows"


SF_DIR_HOLDER = ["/root/testdata/sf0.01"]


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from loomset.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    SF_DIR_HOLDER[0] = sf_dir
    names = argv[1:] or list(queries())
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names:
        t = time.time()
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:24s} rows-only {n} rows ({time.time() - t:.1f}s)")
            continue
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls[name])
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"error: {str(exc)[:400]}"
        bad += not ok
        print(f"{name:24s} {'OK  ' if ok else 'FAIL'} {msg} ({time.time() - t:.1f}s)", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
