"""Value counts: distinct counts, top values and modes.

Every column is its own branch of a union: it reads only its own column of a columnar file,
shuffles single-column keys in their native type, and combines repeats before the shuffle,
so a hot value is one row per task. Profile a stored or persisted table rather than a long
derivation: each branch reads its input again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import (
    FRACTIONAL,
    INTEGRAL,
    chunks,
    col,
    data_type,
    local_frame,
    pct,
    scalar_columns,
)
from prepflow.session import together


def _value(df: DataFrame, name: str) -> Column:
    if isinstance(data_type(df, name), FRACTIONAL):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def distinct_counts(df: DataFrame, names: Sequence[str] | None = None, approx: bool = False) -> dict[str, int]:
    """Exact distinct non-null count per column (``approx`` trades exactness for no shuffle)."""
    names = list(names if names is not None else scalar_columns(df))
    count = F.approx_count_distinct if approx else F.count_distinct

    def group(part: Sequence[str]) -> list:
        branches = [df.select(_value(df, n).alias("v")).agg(count("v").alias("k")) for n in part]
        return union_all([b.select(F.lit(n).alias("column"), "k") for n, b in zip(part, branches)]).collect()

    if not names:
        return {}
    groups = [lambda p=p: group(p) for p in chunks(names)]
    found = {r["column"]: int(r["k"]) for rows in together(df.sparkSession, *groups) for r in rows}
    return {n: found[n] for n in names}


def _lane(df: DataFrame, name: str) -> tuple[str, Column]:
    """A column as one of three kinds of value, so that different values stay different."""
    kind = data_type(df, name)
    if isinstance(kind, FRACTIONAL):
        return "d", _value(df, name).cast("double")
    if isinstance(kind, INTEGRAL):
        return "i", col(name).cast("bigint")
    if isinstance(kind, T.BooleanType):
        return "i", col(name).cast("int").cast("bigint")
    if isinstance(kind, T.TimestampType):
        return "i", F.unix_micros(col(name))
    if isinstance(kind, T.DateType):
        return "i", F.unix_date(col(name)).cast("bigint")
    return "t", col(name).cast("string")


def counts_and_tops(df: DataFrame, names: Sequence[str], ranked: Sequence[str], k: int) -> tuple[dict[str, int], list[tuple]]:
    """Distinct non-null values of ``names``, and the ``k`` most frequent ones of the text columns ``ranked``.

    One long table of (column, value, count), shuffled once, gives both; repeats combine before. The second
    part is (column, value, count, rank) as from ``top_values``.
    """
    if not names:
        return {}, []
    lanes = {n: _lane(df, n) for n in names}
    types = {"i": "bigint", "d": "double", "t": "string"}
    cells = [
        F.struct(
            F.lit(at).alias("c"),
            *[(value if lane == own else F.lit(None)).cast(kind).alias(lane) for lane, kind in types.items()],
        )
        for at, (own, value) in enumerate(lanes.values())
    ]
    long = df.select(F.inline(F.array(*cells))).where("i is not null or d is not null or t is not null")
    counts = long.groupBy("c", "i", "d", "t").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(
        "c", F.lit(None).cast("string").alias("t"), "n", F.lit(0).alias("rank")
    )
    places = [at for at, n in enumerate(names) if n in ranked]
    if places:
        order = Window.partitionBy("c").orderBy(F.desc("n"), F.asc("t"))
        tops = counts.where(F.col("c").isin(places)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.unionByName(tops.select("c", "t", "n", "rank"))
    rows = found.collect()
    distinct = dict.fromkeys(names, 0) | {names[r["c"]]: int(r["n"]) for r in rows if r["rank"] == 0}
    return distinct, [(names[r["c"]], r["t"], r["n"], r["rank"]) for r in rows if r["rank"]]


def unique_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per column: distinct count and its share of all rows."""
    names = list(names if names is not None else scalar_columns(df))
    counts, n = together(df.sparkSession, lambda: distinct_counts(df, names), df.count)
    frame = local_frame(
        df.sparkSession, [(c, counts[c], n) for c in names], "column string, unique_count bigint, n bigint"
    )
    return frame.select("column", "unique_count", pct(F.col("unique_count"), F.col("n")).alias("unique_pct"))


def column_nunique(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    names = list(names if names is not None else scalar_columns(df))
    counts = distinct_counts(df, names)
    return local_frame(df.sparkSession, list(counts.items()), "column string, nunique bigint")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, count) of the non-null values of one column."""
    values = df.select(_value(df, name).alias("value")).where(F.col("value").isNotNull())
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, names: Sequence[str], k: int = 15) -> DataFrame:
    """The ``k`` most frequent values of each column as text; ties go to the smaller value.

    Each column is a top-k of its own counts; only k rows per column are then ranked.
    """
    texts = df.select(*[col(n).cast("string").alias(n) for n in names])
    tops = union_all(
        [
            value_counts(texts, n)
            .orderBy(F.desc("count"), F.asc("value"))
            .limit(k)
            .select(F.lit(n).alias("column"), "value", "count")
            for n in names
        ]
    )
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return tops.withColumn("rank", F.row_number().over(order))


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column in its own type; ties go to the smallest.

    The smallest (-count, value) pair is a plain aggregate: no sort.
    """
    best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("best")

    def one(name: str) -> object:
        found = value_counts(df, name).agg(best).first()["best"]
        return found["value"] if found is not None else None

    if not names:
        return {}
    return dict(zip(names, together(df.sparkSession, *[lambda n=n: one(n) for n in names])))


def top_value(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Most common value with its frequency and share of all rows."""
    n = df.count()
    best = top_values(df, names, 1)
    return best.select(
        "column",
        F.col("value").alias("top_value"),
        F.col("count").alias("top_freq"),
        pct(F.col("count"), F.lit(n)).alias("top_freq_pct"),
    )
