"""Run registered queries in Spark and their SQL in DuckDB; report differences.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.oracle import SQL  # noqa: E402
from promoloom.plans.registry import QUERIES  # noqa: E402


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    out = [tuple(repr(row[i]) if isinstance(row[i], float) else str(row[i]) for i in order)
           for row in rows]
    return sorted(out)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str | None:
    """None when equal, else a short text."""
    got = QUERIES[name](spark, folder)
    names = got.columns
    rows = [tuple(x) for x in got.collect()]
    if name not in SQL:
        return None if rows else "no rows"
    result = con.execute(SQL[name])
    sql_names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(sql_names):
        return f"columns {sorted(names)} / {sorted(sql_names)}"
    a, b = normal(rows, names), normal(expected, sql_names)
    if a == b:
        return None
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(a)} / {len(b)} rows, {len(wrong)} differ, first {wrong[:2]}"


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("promoloom")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark, con = session(), tables(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        checked = "sql " if name in SQL else "rows"
        print(f"{mark} {checked} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
