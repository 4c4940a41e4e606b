"""Compare registered queries with their SQL checks.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

took: dict[str, float] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.5g}" if value else "0"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _kind(name):
    name = name.lower()
    for key, kinds in {
        "int": ("bigint", "long", "int"), "float": ("double",), "text": ("varchar", "string"),
        "bool": ("boolean",),
    }.items():
        if name in kinds:
            return key + (":" + ("64" if name in ("bigint", "long") else "32") if key == "int" else "")
    return name


def compare(spark, con, name, build, sql, sf_dir):
    """Returns (message or None, number of rows)."""
    took.setdefault("start", time.time())
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_cell(r[c]) for c in cols) for r in df.collect()]
    took["spark"] = time.time() - took["start"]
    if sql is None:
        return None, len(got)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: _kind(str(d[1])) for d in res.description}
    rows = res.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} <> {sorted(names)}", len(got)
    spark_kinds = {c: _kind(t) for c, t in df.dtypes}
    for c in cols:
        if spark_kinds[c] != kinds[c]:
            return f"type of {c}: {spark_kinds[c]} <> {kinds[c]}", len(got)
    at = [names.index(c) for c in cols]
    want = [tuple(_cell(r[i]) for i in at) for r in rows]
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} <> {len(want)} {extra}", len(got)
    if sorted(got) != sorted(want):
        extra = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"values differ {cols}: {extra}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession

    from soundquay.plans import load_catalogue

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, item in load_catalogue().items():
        if wanted and not any(w in name for w in wanted):
            continue
        took["start"] = time.time()
        took["spark"] = -1.0
        try:
            message, n = compare(spark, con, name, item.build, item.sql, sf_dir)
        except Exception as error:  # report and go on
            message, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        total = time.time() - took["start"]
        bad += message is not None
        kind = "sql " if item.sql else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {kind} {name} n={n} spark={took['spark']:.1f}s all={total:.1f}s", message or "",
              flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
