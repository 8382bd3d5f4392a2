"""Run a registered Spark query and its DuckDB oracle side by side and compare them.

Mirrors the driver's check: columns sorted by name, row count, order-insensitive values.
Usage: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, repr(round(v, 6) + 0.0))
    return (1, repr(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


_DUCK_TO_SPARK = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "FLOAT": "float",
    "SMALLINT": "smallint",
    "TINYINT": "tinyint",
}


def type_mismatches(sdf, res):
    spark_types = dict(sdf.dtypes)
    out = []
    for name, dtype, *_ in res.description:
        d = _DUCK_TO_SPARK.get(str(dtype), str(dtype))
        if spark_types.get(name) != d:
            out.append((name, spark_types.get(name), str(dtype)))
    return out


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    con.sql(sql).create_view("_oracle", replace=True)  # the driver holds every oracle as a view
    res = con.execute("select * from _oracle")
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    a, ac = rows_of(s_cols, s_rows)
    b, bc = rows_of(d_cols, d_rows)
    types = type_mismatches(sdf, res)
    ok = ac == bc and a == b and not types
    detail = ""
    if not ok:
        if types:
            detail = f"types (col, spark, duck) {types}"
        elif ac != bc:
            detail = f"columns spark={ac} duck={bc}"
        elif len(a) != len(b):
            detail = f"rows spark={len(a)} duck={len(b)}"
        else:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            detail = f"values differ, e.g. {diff}"
    return ok, len(s_rows), t1 - t0, detail


def main(argv):
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"ROWS  {name:32s} rows={n} (no oracle)")
            continue
        try:
            ok, n, dt, detail = compare(spark, con, sf_dir, name, qs[name], sqls[name])
        except Exception as e:  # report and go on
            ok, n, dt, detail = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {name:32s} rows={n} {dt:6.2f}s {detail}", flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
