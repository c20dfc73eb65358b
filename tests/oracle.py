"""Run a registered query and its SQL on the same tables and compare every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{Path(sf_dir) / name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return str(value)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, v or "") for v in r)
    )


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    rows = spark_df.collect()
    left = _table(spark_df.columns, rows)
    cursor = con.execute(sql)
    right = _table([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y]
            return f"{bad[:4]} in {a[:6]}"
    if not rows:
        return "no rows"
    return None
