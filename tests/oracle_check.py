"""Run every registered query next to its DuckDB twin and compare the rows.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(query, sql, spark, con, sf_dir) -> str:
    """'' if columns and rows agree, else what differs first."""
    result = query(spark, sf_dir)
    rows = [tuple(row) for row in result.collect()]
    twin = con.execute(sql)
    columns = [d[0] for d in twin.description]
    if sorted(columns) != sorted(result.columns):
        return f"columns {result.columns} vs {columns}"
    ours, theirs = _sorted_rows(result.columns, rows), _sorted_rows(columns, twin.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    return next((f"{a} vs {b}"[:600] for a, b in zip(ours, theirs) if a != b), "")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from scorelens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, twins = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(), connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            if name in twins:
                verdict = compare(queries[name], twins[name], spark, con, sf_dir) or "ok"
            else:
                verdict = f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as error:
            verdict = "ERROR " + str(error)[:500].replace("\n", " ")
        print(f"{time.time() - start:7.2f}s {name}: {verdict}", flush=True)
