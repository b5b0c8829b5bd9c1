"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    """A value in a form that both engines share; floats by nine digits."""
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir, query, sql):
    """Rows of Spark, rows of DuckDB (None without SQL), and whether they agree."""
    import duckdb

    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if sql is None:
        return got, None, True
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        at = f"{sf_dir}/{name}"
        db.execute(f"create view {name.removesuffix('.parquet')} as from '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    return got, want, got == want and sorted(names) == sorted(df.columns)


if __name__ == "__main__":
    sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
    os.environ["PYTHONPATH"] = ROOT
    import tempfile

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            got, want, ok = compare(spark, sys.argv[1], queries[name], sqls.get(name))
            print(f"{name}: {'same' if ok and want is not None else 'rows only' if ok else 'DIFFERENT'}, {len(got)} rows, {time.time() - began:.1f} s", flush=True)
            if not ok:
                a, b = set(map(repr, got)), set(map(repr, want))
                print("  only Spark:", sorted(a - b)[:3], "\n  only SQL:", sorted(b - a)[:3], len(a - b), len(b - a), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: FAILED {str(e)[:1500]}", flush=True)
