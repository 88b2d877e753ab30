"""Run queries on Spark and their SQL on DuckDB and compare the results.

    python -m checks.compare /root/testdata/sf0.001 [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, datetime.datetime):
        return x.date() if x.time() == datetime.time(0) else x
    return x


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> str:
    """'' when both agree, else what differs."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    ours = canonical(spark_df.columns, spark_df.collect())
    theirs = canonical(names, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    if not ours:
        return "no rows"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    typed = [(a, b) for a, b in zip(ours[0], theirs[0]) if a is not None and b is not None and type(a) is not type(b)]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, columns {sorted(names)}, e.g. {different[0]}"
    return f"types differ {typed}" if typed else ""


def main(folder: str, names: list[str]) -> int:
    from checks.oracle import SQL
    from epilattice.plans.catalog import QUERIES
    from epilattice.session import local_session

    spark, con, bad = local_session(8), connect(folder), 0
    for name in names or list(QUERIES):
        if name not in SQL:
            print(f"{name:26s} no SQL")
            continue
        start = time.time()
        try:
            verdict = compare(QUERIES[name](spark, folder), con, SQL[name])
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(verdict)
        print(f"{name:26s} {'ok' if not verdict else 'FAIL ' + verdict} {time.time() - start:.1f}s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
