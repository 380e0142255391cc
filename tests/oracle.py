"""Run registered queries next to their SQL in DuckDB and compare the results.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("tablepact")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(names)


KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
         "int": "INTEGER"}


def compare(spark, con, name, run, sql, sf_dir) -> str:
    df = run(spark, sf_dir)
    got, got_names = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want, want_names = rows_of(names, rel.fetchall())
    if got_names != want_names:
        return f"COLUMNS {got_names} != {want_names}"
    types = dict(zip(names, [str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()]))
    off = [(c, t, types[c]) for c, t in df.dtypes if KINDS.get(t) != types[c]]
    if off:
        return f"TYPES {off}"
    if got != want:
        extra = [g for g in got if g not in want][:3]
        lack = [w for w in want if w not in got][:3]
        return f"VALUES {len(got)} rows against {len(want)}: only Spark {extra}, only SQL {lack}"
    return f"ok {len(got)}"


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    sf_dir, chosen = argv[0], argv[1:]
    spark, con = spark_session(), duck(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, run in queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as exc:
            verdict = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict[:1500]}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
