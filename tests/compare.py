"""Side-by-side run of a query and its reference SQL."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, build, sql, folder):
    """(equal, message)"""
    t0 = time.time()
    df = build(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    t1 = time.time()
    result = con.execute(sql)
    names, want = rows_of([d[0] for d in result.description], result.fetchall())
    took = f"spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s"
    if got_names != names:
        return False, f"columns {got_names} != {names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)} {took} got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, {names}: {bad[:3]} {took}"
    return True, f"{len(got)} rows {took}"


def main(argv):
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = f"/root/testdata/{argv[0]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(sql)
    failed = 0
    for name in queries:
        if not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            if name in sql:
                ok, message = compare(spark, con, queries[name], sql[name], folder)
            else:
                t0 = time.time()
                ok, message = True, f"no SQL, {queries[name](spark, folder).count()} rows {time.time() - t0:.1f}s"
        except Exception as error:  # keep going, report the first lines
            ok, message = False, str(error)[:1500]
        failed += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
