"""Run queries next to their SQL and compare rows by value.

    python tests/compare.py [-s sf0.01] [name prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{kind(v)}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """'' if both sides agree, else a short text on the difference."""
    df = fn(spark, sf_dir)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if left else "no rows"
    cur = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}\n  {left[:2]}\n  {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ\n  {left_cols}\n  {bad[0][0]}\n  {bad[0][1]}"
    return "" if left else "both empty"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf = "sf0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"{ROOT}/{sf}"
    import __spark_entry__ as e

    spark, con, failed = session(), duck(sf_dir), []
    oracle = e.oracle_sql()
    for name, fn in e.queries().items():
        if argv and not any(name == a or name.startswith(a + "_") for a in argv):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if diff:
            failed.append(name)
        print(f"{'FAIL' if diff else 'ok  '} {time.time() - t:6.2f}s {name} {diff}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
