"""Run registered queries in Spark and their SQL in DuckDB and compare every value.

    python tests/compare.py [--sf DIR] [name prefixes...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        x = float(value)
        return "nan" if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def compare(columns, rows, other_columns, other_rows) -> str | None:
    """A description of the first difference, or None."""
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} vs {sorted(other_columns)}"
    if len(rows) != len(other_rows):
        return f"rows {len(rows)} vs {len(other_rows)}"
    order = sorted(columns)
    a, b = [columns.index(c) for c in order], [other_columns.index(c) for c in order]
    left = sorted((tuple(plain(r[i]) for i in a) for r in rows), key=repr)
    right = sorted((tuple(plain(r[i]) for i in b) for r in other_rows), key=repr)
    for x, y in zip(left, right):
        if x != y:
            return f"values {dict(zip(order, x))} vs {dict(zip(order, y))}"
    return None


def main() -> int:
    from hydrolens.session import build_session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    directory = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        directory, args = args[1], args[2:]
    spark = build_session("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(directory), oracle_sql(), []
    for name, run in queries().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        start = time.time()
        try:
            df = run(spark, directory)
            rows = df.collect()
            took = time.time() - start
            if name in sql:
                rel = con.sql(sql[name])
                problem = compare(df.columns, rows, rel.columns, rel.fetchall())
                types = [(c, t, str(u)) for (c, t), u in zip(sorted(df.dtypes), [u for _, u in sorted(zip(rel.columns, rel.types))])]
                odd = [x for x in types if x[2] in ("HUGEINT",) or x[2].startswith("DECIMAL")]
                if odd and not problem:
                    problem = f"types {odd}"
            else:
                problem = None if rows else "no rows"
            status = "ok" if problem is None else "DIFF " + problem
        except Exception as error:
            took, status = time.time() - start, f"FAIL {type(error).__name__}: {str(error)[:600]}"
        if status != "ok":
            failed.append(name)
        if status != "ok" or took > 4 or os.environ.get("VERBOSE"):
            print(f"{name:34s} {took:6.2f}s {'' if name in sql else '(no sql)'} {status}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
