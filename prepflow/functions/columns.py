"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.session import together

FRACTIONAL = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = FRACTIONAL + INTEGRAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Past this many aggregates in one scan the generated code is too long to be compiled (measured).
AGGS_PER_SCAN = 48
# A side that Spark's own statistics prove this small may be broadcast.
BROADCAST_BYTES = 32 << 20


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str) -> Column:
    """A column as double, of a table whose NaN is NULL already."""
    return col(name).cast("double")


def dbl(name: str) -> Column:
    """A column as double; NaN is NULL, as everywhere in this package."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be counted and compared."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]


def chunks(items: Sequence, each: int = 1) -> list:
    """Consecutive groups whose aggregates, ``each`` per item, fit one scan."""
    size = max(1, AGGS_PER_SCAN // each)
    return [items[i : i + size] for i in range(0, len(items), size)]


def aggregate(df: DataFrame, exprs: Sequence[Column]) -> list:
    """The values of any number of aggregates over the whole table.

    Wide lists become several scans submitted together; a columnar source then still reads
    every column once.
    """
    groups = chunks(list(exprs))
    if len(groups) <= 1:
        return list(df.agg(*exprs).first()) if groups else []
    rows = together(df.sparkSession, *[lambda g=g: df.agg(*g).first() for g in groups])
    return [value for row in rows for value in row]


def sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if the statistics of its plan bound its bytes, else as it is.

    Nothing runs: the bound comes from file sizes. Beyond it the join shuffles, unless adaptive
    execution finds the side small after all.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= BROADCAST_BYTES else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL: the operators know one kind of missing value."""
    frac = {f.name for f in df.schema if isinstance(f.dataType, FRACTIONAL)}
    if not frac:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in frac else col(n)
            for n in df.columns
        ]
    )


def per_column_agg(
    df: DataFrame, names: Sequence[str], parts: Mapping[str, Callable[[str], Column]]
) -> DataFrame:
    """One scan, one row per column: ``column`` plus one field per entry of ``parts``."""
    out = None
    for group in chunks(list(names), len(parts)):
        cells = [
            F.struct(F.lit(n).alias("column"), *[fn(n).alias(k) for k, fn in parts.items()])
            for n in group
        ]
        part = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def pct(part: Column, whole: Column) -> Column:
    """Percentage over max(whole, 1), two decimals."""
    return F.round(part.cast("double") / F.greatest(whole, F.lit(1)) * 100, 2)


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A DataFrame of driver-side results: at most a few rows per table column."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def round_half_up(value: float | None, digits: int) -> float | None:
    """The rounding of the SQL ``round``, for values finished on the driver."""
    if value is None or value != value:
        return None
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a date or timestamp, free of the session zone for zone-less types."""
    kind = data_type(df, name)
    c = col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint") * F.lit(86_400_000_000)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("bigint")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    fraction = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return (day * 86_400 + seconds) * F.lit(1_000_000) + fraction
