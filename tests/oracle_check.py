"""Compare every registered query with its SQL equivalent: ``python tests/oracle_check.py <sf_dir> [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return repr(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    got = spark_df.collect()
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(spark_df.columns) != sorted(want_names):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_names)}"
    a, b = _rows(spark_df.columns, [tuple(r) for r in got]), _rows(want_names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"\n   got  {str(x)[:700]}\n   want {str(y)[:700]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from corpusloom.session import build_session
    from pyspark.sql import SparkSession

    sf_dir, names = sys.argv[1], sys.argv[2:]
    if os.environ.get("PLAIN"):  # Spark defaults only
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                              spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                n = df.count() if names else ""
            else:
                problem, n = f"no oracle, {df.count()} rows", ""
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - begin:.2f}s {n} {problem or ''}", flush=True)
    print("differences:", bad)
