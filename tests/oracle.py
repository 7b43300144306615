"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/oracle.py [-s SF_DIR] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.01"


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    from oddrows.checks.base import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def normal(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    """None when equal (or no SQL and rows came back), else a message."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} / {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ: {bad[:2]}"
    return None if got[1] else "no rows"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = SF
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    spark, con = local_session(), duck(sf)
    names = [n for n in queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, sf, n)
        except Exception as err:
            msg = f"{type(err).__name__}: {str(err)[:600]}"
            if len(names) < 4:
                traceback.print_exc()
        failed += msg is not None
        kind = "sql" if n in oracle_sql() else "rows"
        if msg or time.time() - t > 2 or len(names) < 12:
            print(f"{'FAIL' if msg else 'ok'} {n} [{kind}] {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{len(names)} run, {failed} failed")
