"""Run registered queries in Spark and their SQL in DuckDB, and compare all rows.

As a script: python tests/compare.py <folder of tables> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v + 0.0:.12g}")
        return v

    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs first."""
    spark_cols, spark_rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    duck_cols, duck_rows = canonical([c[0] for c in result.description], result.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} / {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} / {len(duck_rows)} rows"
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(spark_rows)} rows differ, first {bad[0]}"
    types = [type(v) for v in spark_rows[0]] if spark_rows else []
    duck_types = [type(v) for v in duck_rows[0]] if duck_rows else []
    return None if types == duck_types else f"types {types} / {duck_types}"


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - report and go on
            state = "ERROR " + str(error)[:600]
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
