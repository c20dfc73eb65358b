"""Semantic column types: numeric, categorical, datetime, boolean or text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import (
    NESTED,
    NUMERIC,
    TEMPORAL,
    aggregate,
    col,
    local_frame,
    per_column_agg,
    string_columns,
)

# fixed values
KINDS = ("numeric", "categorical", "datetime", "boolean", "text")
TEXT_LENGTH = 80
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
)
DATE_FORMATS = (None, "yyyy/M/d", "M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy")


@dataclass(frozen=True)
class ColumnTypes:
    """Column names by semantic type, in table order."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    datetime: tuple[str, ...] = ()
    boolean: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    order: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def of(cls, kinds: dict[str, str]) -> "ColumnTypes":
        return cls(
            **{k: tuple(n for n, kind in kinds.items() if kind == k) for k in KINDS}, order=tuple(kinds)
        )

    def kind(self, name: str) -> str:
        return next(k for k in KINDS if name in getattr(self, k))

    def items(self) -> list[tuple[str, str]]:
        return [(n, self.kind(n)) for n in self.order]


def parse_datetime(c: Column) -> Column:
    """A timestamp from a date-shaped string, else NULL; never raises."""
    tries = [
        F.when(
            c.rlike(shape),
            F.try_to_timestamp(c) if fmt is None else F.try_to_timestamp(c, F.lit(fmt)),
        )
        for shape, fmt in zip(DATE_SHAPES, DATE_FORMATS)
    ]
    return F.coalesce(*tries)


DATE_COUNTS = {
    "probed": lambda n: F.count(col(n)),
    "parsed": lambda n: F.count(F.when(parse_datetime(F.trim(col(n))).isNotNull(), 1)),
}


def datetime_probe(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per string column: how many values are present and how many read as dates, over all rows.

    A column of dates has no other value: one text among them and it stays text.
    """
    names = list(names if names is not None else string_columns(df))
    if not names:
        return local_frame(df.sparkSession, [], "column string, probed bigint, parsed bigint, is_datetime boolean")
    return per_column_agg(df, names, DATE_COUNTS).withColumn(
        "is_datetime", (F.col("probed") > 0) & (F.col("parsed") == F.col("probed"))
    )


def avg_text_length(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Mean character length of the non-null values per string column."""
    names = list(names if names is not None else string_columns(df))
    return per_column_agg(df, names, {"avg_length": lambda n: F.avg(F.length(col(n)))})


def type_facts(name: str) -> list[Column]:
    """What decides the type of a string column: values, values that are dates, mean length."""
    return [DATE_COUNTS["probed"](name), DATE_COUNTS["parsed"](name), F.avg(F.length(col(name)))]


def types_of(df: DataFrame, facts: dict[str, Sequence]) -> ColumnTypes:
    """Type every column: by schema first, strings by whether all are dates and by their mean length."""
    kinds = {}
    for f in df.schema:
        kind = f.dataType
        probed, parsed, length = facts.get(f.name, (0, 0, 0.0))
        if isinstance(kind, T.BooleanType):
            kinds[f.name] = "boolean"
        elif isinstance(kind, TEMPORAL):
            kinds[f.name] = "datetime"
        elif isinstance(kind, NUMERIC):
            kinds[f.name] = "numeric"
        elif probed and parsed == probed:
            kinds[f.name] = "datetime"
        elif (length or 0.0) > TEXT_LENGTH:
            kinds[f.name] = "text"
        elif isinstance(kind, NESTED):
            raise TypeError(f"column {f.name!r} has type {kind.simpleString()}: flatten or drop it first")
        else:
            kinds[f.name] = "categorical"
    return ColumnTypes.of(kinds)


def detect_column_types(df: DataFrame) -> ColumnTypes:
    """The types of a table whose strings have not been looked at."""
    strings = string_columns(df)
    found = aggregate(df, [a for n in strings for a in type_facts(n)])
    return types_of(df, {n: found[3 * i : 3 * i + 3] for i, n in enumerate(strings)})


def column_types(df: DataFrame) -> DataFrame:
    rows = detect_column_types(df).items()
    return local_frame(df.sparkSession, rows, "column string, kind string")


def type_distribution(df: DataFrame) -> DataFrame:
    """Number of columns per semantic type; types without columns are left out."""
    return column_types(df).groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


def time_columns(types: ColumnTypes) -> list[str]:
    """Columns that can index a time series."""
    return list(types.datetime)
