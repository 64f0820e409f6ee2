"""Run queries next to their oracle SQL: python tests/check_oracles.py [sf] [prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    columns, got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    wanted_columns, wanted = normal(names, result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} vs {wanted_columns}"
    numbers = {"DOUBLE": "double", "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string",
               "BOOLEAN": "boolean"}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {c: (types[c], k) for c, k in kinds.items() if numbers.get(k) != types[c]}
    if len(got) != len(wanted):
        return f"{len(got)} rows vs {len(wanted)}"
    if got != wanted:
        bad = [(a, b) for a, b in zip(got, wanted) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"types differ: {odd}" if odd else ""


def main(argv):
    sf = argv[0] if argv else "sf0.01"
    prefixes = argv[1:]
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sf}"
    spark, con = session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = "" if df.count() >= 0 else "?"
        except Exception as error:  # keep going, report at the end
            lines = traceback.format_exc().strip().splitlines()
            where = [x for x in lines if ROOT in x][-1:]
            problem = f"{type(error).__name__}: {str(error)[:600]} {where}"
        mark = "ok  " if not problem else "FAIL"
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - start:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
