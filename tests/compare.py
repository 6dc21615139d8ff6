"""Run named queries on Spark and their check queries on DuckDB and compare all values.

Usage: python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    return str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark_df, con, sql: str) -> str | None:
    got_columns = spark_df.columns
    got = normal(got_columns, spark_df.collect())
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = normal(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first got-only {next((g for g in got if g not in set(want)), None)}; first want-only {next((w for w in want if w not in set(got)), None)}"
    for g, w in zip(got, want):
        if g != w:
            return f"values {g} vs {w} in {sorted(got_columns)}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from turfline.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, checks, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = differences(df, con, checks[name]) if name in checks else f"(rows only: {df.count()})"
        except Exception as error:  # report and go on
            problem = f"ERROR {type(error).__name__}: {str(error)[:600]}"
            if names:
                traceback.print_exc()
        state = "ok  " if problem is None else ("rows" if problem.startswith("(rows") else "BAD ")
        bad += state == "BAD "
        print(f"{state} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
