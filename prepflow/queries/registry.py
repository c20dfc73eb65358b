"""Registered queries: a Spark callable per key, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from prepflow.sources.tables import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by unit tests only."""

    def add(fn):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


class View:
    """A derived table written once, as select expressions both engines read alike."""

    def __init__(self, base: str, exprs: Sequence[str]):
        self.base, self.exprs = base, list(exprs)

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.base).selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.exprs)} FROM {self.base}"


# Orders with gaps in a number, a category and a date.
ORDERS_N = View(
    "orders",
    [
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    ],
)
# Few columns, many copies.
ORDERS_D = View("orders", ["o_orderstatus", "o_orderpriority", "CAST(year(o_orderdate) AS BIGINT) AS y"])
# A series with gaps.
EVENTS_N = View(
    "events",
    ["event_id", "ts", "event_type", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value"],
)
# Correlated, constant and numeric-text columns.
LINE_X = View(
    "lineitem",
    [
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_extendedprice * 1.1 + l_quantity AS l_gross",
        "CAST(1 AS INT) AS l_const",
        "CAST(l_partkey AS VARCHAR(20)) AS l_parttext",
        "l_returnflag",
    ],
)


def docs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where known: mostly missing."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS_L = "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"

NUMERIC = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ],
    "events": ["event_id", "user_id", "value"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
}
COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
}


def each(columns: Sequence[str], template: str) -> str:
    """UNION ALL of a per-column statement; ``{c}`` is the column, ``{i}`` its position."""
    return "\nUNION ALL\n".join(template.replace("{c}", c).replace("{i}", str(i)) for i, c in enumerate(columns))


def pct_sql(part: str, whole: str) -> str:
    return f"round(({part})::DOUBLE / greatest({whole}, 1) * 100, 2)"
