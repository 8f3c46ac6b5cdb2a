"""Runs every query that has SQL next to its oracle; prints what differs."""

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    cols = sorted(df.columns)
    return list(tuple(None if pd.isna(v) else round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)) if len(df) else []


def compare(spark, sf_dir, only=()):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    sql, bad = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            got = run(spark, sf_dir)
            got = got.toPandas()
            if name in sql:
                want = con.execute(sql[name]).df()
                a, b = sorted(map(repr, rows(got))), sorted(map(repr, rows(want)))
                if sorted(got.columns) != sorted(want.columns) or a != b:
                    bad.append(name)
                    print("DIFF", name, len(a), len(b), sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2], sorted(got.columns) == sorted(want.columns))
                elif not len(a):
                    print("EMPTY", name)
            print("..", name, len(got), round(time.time() - t, 1), flush=True)
        except Exception as e:
            bad.append(name)
            print("FAIL", name, str(e)[:400].replace("\n", " "), flush=True)
    return bad


if __name__ == "__main__":
    s = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    print("BAD", compare(s, sys.argv[1], sys.argv[2:]))
