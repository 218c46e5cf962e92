"""Runs registered queries beside their SQL in DuckDB and compares the rows: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v: object) -> object:
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    rel = con.execute(sql)
    theirs = canonical([d[0] for d in rel.description], rel.fetchall())
    if mine[0] != theirs[0]:
        return f"{name}: columns {mine[0]} against {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"{name}: {len(mine[1])} rows against {len(theirs[1])}; only here {sorted(a - b)[:3]} ({len(a - b)}), only there {sorted(b - a)[:3]} ({len(b - a)})"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            said = compare(spark, name, queries[name], sqls[name], sf_dir) or "same" if name in sqls else f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name} {time.time() - began:.1f}s {said}", flush=True)


if __name__ == "__main__":
    main()
