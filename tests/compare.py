"""python tests/compare.py [FOLDER] [NAME...]: queries against their SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings assets observations findings audit_jobs audit_runs audit_results ledger_events import_records eval_items".split()


def session(cpus: str = "8") -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(x):
    """A value in a form that both engines share; numbers by value, times as naive UTC."""
    if x is None or x != x:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return "~" if math.isnan(x) else f"{float(x):.9g}"
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows(columns, data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(plain(r[i]) for i in order) for r in data)


def difference(spark, con, folder: str, query, sql: str) -> str:
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only here {sorted(sa - sb)[:3]}; only SQL {sorted(sb - sa)[:3]}"
    return "" if a else "empty"


def main() -> None:
    import __spark_entry__ as e

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con, q, sql = session(), duck(folder), e.queries(), e.oracle_sql()
    bad = 0
    for name in args or q:
        t = time.time()
        try:
            said = difference(spark, con, folder, q[name], sql[name]) if name in sql else f"no SQL, {q[name](spark, folder).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        if said or len(args) > 0:
            print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("differing:", bad, "of", len(args or q))


if __name__ == "__main__":
    main()
