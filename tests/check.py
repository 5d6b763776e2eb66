"""Compare registered queries with their SQL on the given tables: python -m tests.check [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 + v if v else 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted([tuple(norm(r[i]) for i in order) for r in rows])


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got[1]), None
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return len(got[1]), f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return len(got[1]), f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]} cols {got[0]}"
    return len(got[1]), None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from ledgerloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(entry.queries())
    spark = local_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for n in names:
        t = time.time()
        try:
            count, err = compare(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            count, err = -1, f"{type(e).__name__}: {str(e)[:600]}"
        failed += err is not None
        tag = "FAIL" if err else ("ok" if n in oracles else "rows-only")
        print(f"{tag:9} {n:20} rows={count} {time.time() - t:.2f}s {err or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    spark.stop()
    sys.exit(1 if failed else 0)
