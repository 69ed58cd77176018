"""Compare registered queries with their SQL on the driver's tables: python -m tests.compare SF_DIR [NAME...]"""

import glob
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, bytearray):
        return bytes(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        only, missing = [r for r in got[1] if r not in set(want[1])][:3], [r for r in want[1] if r not in set(got[1])][:3]
        return f"{len(got[1])} rows and {len(want[1])}; only here {only}; missing {missing}"
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or [n for n in queries if n in sql]:
        began = time.time()
        try:
            wrong = difference(spark, con, sf_dir, queries[name], sql[name])
        except Exception as e:  # noqa: BLE001
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if wrong is None else 'DIFF'} {name} {time.time() - began:.1f}s {wrong or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
