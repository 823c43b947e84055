"""Runs a registered query next to its SQL twin and compares the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

SMALL = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
         "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def spark_rows(df) -> tuple[list[str], list[tuple], dict[str, str]]:
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=_key), {f.name: f.dataType.simpleString() for f in df.schema}


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple], dict[str, str]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    return sorted(names), sorted(rows, key=_key), types


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, int]:
    started = time.time()
    names, rows, kinds = spark_rows(driver.queries()[name](spark, sf_dir))
    seconds = time.time() - started
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return "no sql", seconds, len(rows)
    sql_names, expected, sql_kinds = sql_rows(con, sql)
    if names != sql_names:
        return f"columns {names} != {sql_names}", seconds, len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}", seconds, len(rows)
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}", seconds, len(rows)
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
            "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    odd = {n: (k, sql_kinds[n]) for n, k in kinds.items() if same.get(k) != sql_kinds[n]}
    return (f"same, types {odd}" if odd else "same"), seconds, len(rows)


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session("compare", "local[8]", SMALL)
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    for query in sys.argv[2:] or list(driver.queries()):
        try:
            verdict, took, n = compare(session, connection, query, sf)
        except Exception as err:  # report and go on to the next query
            verdict, took, n = f"ERROR {str(err)[:600]}", 0.0, -1
        print(f"{query:28s} {took:6.2f}s {n:8d} {verdict[:900]}", flush=True)
