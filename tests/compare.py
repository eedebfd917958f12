"""Compare a Spark result with a DuckDB result by value, whatever the row and column order."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a short account of what differs."""
    got_columns, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    result = con.execute(sql)
    want_columns, want = [d[0] for d in result.description], result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    left, right = _rows(got_columns, got), _rows(want_columns, want)
    if left == right:
        return None
    extra = [r for r in left if r not in set(right)][:2]
    lacking = [r for r in right if r not in set(left)][:2]
    return f"{len(left)} vs {len(right)} rows; only Spark {extra}; only SQL {lacking}"
