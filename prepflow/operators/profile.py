"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import (
    aggregate,
    col,
    dbl,
    local_frame,
    nan_to_null,
    num,
    numeric_columns,
    pct,
    per_column_agg,
    round_half_up,
    scalar_columns,
    string_columns,
)
from prepflow.functions.moments import (
    adjusted_kurtosis,
    adjusted_skewness,
    fences,
    moments_from_sums,
)
from prepflow.operators.duplicates import count_duplicates
from prepflow.operators import quantiles
from prepflow.operators.frequency import counts_and_tops
from prepflow.operators.quantiles import (
    bracket_counts,
    brackets_of,
    clean_value,
    exact_quantiles,
    gathered,
    outlier_tally,
    sketches,
)
from prepflow.operators.types import ColumnTypes, type_facts, types_of
from prepflow.session import together

# fixed values
TOP_K = 15
FIXED_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4,
    "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


# --- whole-table figures -------------------------------------------------------------


def duplicate_rows(df: DataFrame, suspect_share: float | None = None) -> DataFrame:
    total, copies = count_duplicates(df, suspect_share)
    frame = local_frame(df.sparkSession, [(copies, total)], "duplicate_rows bigint, n bigint")
    return frame.select(
        "duplicate_rows", pct(F.col("duplicate_rows"), F.col("n")).alias("duplicate_pct")
    )


def _null_total(df: DataFrame) -> int:
    df = nan_to_null(df)
    return sum(aggregate(df, [F.count(F.when(col(n).isNull(), 1)) for n in df.columns]))


def quality(null_pct: Column, duplicate_pct: Column) -> Column:
    """0-100 from the rounded percentages: completeness 0.6, uniqueness 0.4."""
    return F.round((F.lit(100.0) - null_pct) * 0.6 + (F.lit(100.0) - duplicate_pct) * 0.4, 1)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "Good").when(score >= 60, "Fair").otherwise("Poor")


def table_frame(spark: SparkSession, n_rows: int, n_cols: int, copies: int, nulls: int) -> DataFrame:
    base = local_frame(
        spark,
        [(n_rows, n_cols, copies, nulls)],
        "n_rows bigint, n_cols bigint, duplicate_rows bigint, total_nulls bigint",
    )
    return (
        base.withColumn("total_values", F.col("n_rows") * F.col("n_cols"))
        .withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("n_rows")))
        .withColumn("null_pct", pct(F.col("total_nulls"), F.col("total_values")))
        .withColumn("quality_score", quality(F.col("null_pct"), F.col("duplicate_pct")))
        .withColumn("quality_grade", grade(F.col("quality_score")))
        .withColumn("healthy", F.col("quality_score") >= 70)
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One row: size, duplicates, nulls, quality score and grade."""
    total, copies = count_duplicates(df)
    return table_frame(df.sparkSession, total, len(df.columns), copies, _null_total(df))


def estimated_mb(df: DataFrame) -> DataFrame:
    """Plain data size in megabytes: fixed widths plus the bytes of the strings."""
    fixed, texts = 0, []
    for f in df.schema:
        name = f.dataType.simpleString()
        if name in FIXED_WIDTH:
            fixed += FIXED_WIDTH[name]
        elif isinstance(f.dataType, T.DecimalType):
            fixed += 16
        else:
            texts.append(F.coalesce(F.octet_length(col(f.name).cast("string")), F.lit(0)))
    size = F.lit(fixed).cast("bigint")
    for t in texts:
        size = size + t
    return df.agg(F.round(F.coalesce(F.sum(size), F.lit(0)) / 1e6, 3).alias("estimated_mb"))


def total_values(df: DataFrame) -> DataFrame:
    return df.agg((F.count(F.lit(1)) * len(df.columns)).alias("total_values"))


# --- per-column figures, one scan each ----------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    rows = per_column_agg(
        df,
        df.columns,
        {
            "null_count": lambda n: F.count(F.when(col(n).isNull(), 1)),
            "n": lambda n: F.count(F.lit(1)),
        },
    )
    return rows.select("column", "null_count", pct(F.col("null_count"), F.col("n")).alias("null_pct"))


def numeric_stats(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum."""
    return per_column_agg(
        df,
        names or numeric_columns(df),
        {
            "mean": lambda n: F.round(F.avg(dbl(n)), 6),
            "std": lambda n: F.round(F.stddev_samp(dbl(n)), 6),
            "min": lambda n: F.min(dbl(n)),
            "max": lambda n: F.max(dbl(n)),
        },
    )


def skewness(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return per_column_agg(
        df,
        names or numeric_columns(df),
        {"skewness": lambda n: F.round(adjusted_skewness(F.count(dbl(n)), F.skewness(dbl(n))), 4)},
    )


def kurtosis(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return per_column_agg(
        df,
        names or numeric_columns(df),
        {"kurtosis": lambda n: F.round(adjusted_kurtosis(F.count(dbl(n)), F.kurtosis(dbl(n))), 4)},
    )


def basic_moments(names: Sequence[str]) -> list[Column]:
    return [f(num(n)) for n in names for f in (F.count, F.avg, F.min, F.max)]


def power_sums(names: Sequence[str], means: dict[str, float | None]) -> list[Column]:
    """Sums of powers around the mean: far smaller code than a central-moment aggregate per statistic."""
    sums = []
    for n in names:
        d = num(n) - F.lit(means[n] or 0.0)
        sums += [F.sum(d), F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)]
    return sums


def moments_of(names: Sequence[str], basic: Sequence, powers: Sequence) -> dict[str, dict]:
    out = {}
    for i, n in enumerate(names):
        size, mean, low, high = basic[4 * i : 4 * i + 4]
        row = {"count": size, "mean": mean, "min": low, "max": high}
        row.update(moments_from_sums(size, *[v or 0.0 for v in powers[4 * i : 4 * i + 4]]))
        if size and low == high:
            for least, key in ((2, "std"), (3, "skewness"), (4, "kurtosis")):
                row[key] = 0.0 if size >= least else None
        out[n] = row
    return out


def moments(df: DataFrame, names: Sequence[str]) -> dict[str, dict]:
    """count, mean, min, max, std, skewness and kurtosis of many columns in two plain scans."""
    names = list(names)
    df = nan_to_null(df.select(*[col(n) for n in names]))
    basic = aggregate(df, basic_moments(names))
    powers = aggregate(df, power_sums(names, dict(zip(names, basic[1::4]))))
    return moments_of(names, basic, powers)


def outlier_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Values strictly outside the fences, as a count and as a share of all rows."""
    names = list(names or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.75])
    n, counts = outlier_tally(df, {c: fences(*quartiles[c]) for c in names}, rows=True)
    frame = local_frame(
        df.sparkSession, [(c, counts[c], n) for c in names], "column string, outlier_count bigint, n bigint"
    )
    return frame.select("column", "outlier_count", pct(F.col("outlier_count"), F.col("n")).alias("outlier_pct"))


# --- the full profile ---------------------------------------------------------------

COLUMN_SCHEMA = (
    "column string, kind string, dtype string, null_count bigint, null_pct double, "
    "unique_count bigint, unique_pct double, unique_ratio double, null_ratio double, "
    "present bigint, mean double, std double, `min` double, `max` double, "
    "q25 double, median double, q75 double, skewness double, kurtosis double, "
    "iqr_lower double, iqr_upper double, outlier_count bigint, outlier_pct double, "
    "outlier_ratio double, top_value string, top_freq bigint, top_freq_pct double"
)
COLUMN_FIELDS = [part.split()[0].strip("`") for part in COLUMN_SCHEMA.split(", ")]


def _share(part: int, whole: int) -> float:
    return round_half_up(part / max(whole, 1) * 100, 2)


@dataclass
class Profile:
    """Everything known about one table: one dict per column, on the driver."""

    spark: SparkSession
    types: ColumnTypes
    n_rows: int
    duplicate_rows: int
    columns: dict[str, dict]
    tops: list[tuple] = field(default_factory=list)

    @property
    def total_nulls(self) -> int:
        return sum(c["null_count"] for c in self.columns.values())

    def table(self) -> DataFrame:
        return table_frame(
            self.spark, self.n_rows, len(self.columns), self.duplicate_rows, self.total_nulls
        )

    def column_frame(self) -> DataFrame:
        rows = [[c.get(k) for k in COLUMN_FIELDS] for c in self.columns.values()]
        return local_frame(self.spark, rows, COLUMN_SCHEMA)

    def top_frame(self) -> DataFrame:
        return local_frame(self.spark, self.tops, "column string, value string, count bigint, rank int")


QUARTILES = [0.25, 0.5, 0.75]


def _scanned(df: DataFrame, types: ColumnTypes | None) -> tuple:
    """Types, rows, nulls, moments, quartiles, fences and outliers: four scans of what depends on each other.

    First counts, means, ranges, what decides types, and quantile sketches; then powers around the means and the
    proof of the sketches' brackets; then the values inside them; then the outliers. A small table has its
    quartiles in place of the second and third.
    """
    names = df.columns
    strings = [] if types else string_columns(df)
    numeric = list(types.numeric) if types else numeric_columns(df)
    values = {n: clean_value(num(n)) for n in numeric}
    first = [F.count(F.lit(1)), *[F.count(F.when(col(n).isNull(), 1)) for n in names]]
    parts = (first, [a for n in strings for a in type_facts(n)], basic_moments(numeric), sketches(values, QUARTILES))
    found = aggregate(df, [a for part in parts for a in part])
    cut = [sum(len(p) for p in parts[:i]) for i in range(len(parts) + 1)]
    (total, *nulls), facts, basic, marks = (found[a:b] for a, b in zip(cut, cut[1:]))
    types = types or types_of(df, {n: facts[3 * i : 3 * i + 3] for i, n in enumerate(strings)})

    sums = power_sums(numeric, dict(zip(numeric, basic[1::4])))
    small = total * len(numeric) <= quantiles.PLAN.builtin_cells
    brackets = brackets_of(values, QUARTILES, marks)
    more = aggregate(df, sums + ([] if small else bracket_counts(values, QUARTILES, brackets)))
    stats = moments_of(numeric, basic, more[: len(sums)])
    if small:
        quartiles = exact_quantiles(df, values, QUARTILES, total)
    else:
        quartiles = gathered(df, values, QUARTILES, brackets, more[len(sums) :], quantiles.PLAN)
    limits = {n: fences(quartiles[n][0], quartiles[n][2]) for n in numeric}
    outliers = outlier_tally(df, limits, {n: num(n) for n in numeric})
    return types, total, dict(zip(names, nulls)), stats, quartiles, limits, outliers


def profile(df: DataFrame, types: ColumnTypes | None = None) -> Profile:
    """Profile a table in a fixed number of scans, whatever its number of columns.

    Beside the scans of ``_scanned`` one long table of values and counts gives distinct counts and top values,
    and one of row hashes the duplicates.
    """
    df = nan_to_null(df)
    scalars = scalar_columns(df)
    texts = [n for n in string_columns(df) if n in scalars] if types is None else list(types.categorical)
    (_, copies), (unique, every_top), scanned = together(
        df.sparkSession,
        lambda: count_duplicates(df),
        lambda: counts_and_tops(df, scalars, texts, TOP_K),
        lambda: _scanned(df, types),
    )
    types, total, nulls, stats, quartiles, limits, outliers = scanned
    tops = [t for t in every_top if t[0] in types.categorical]
    columns = {}
    for n, kind in types.items():
        c = {
            "column": n,
            "kind": kind,
            "dtype": df.schema[n].dataType.simpleString(),
            "null_count": nulls[n],
            "null_pct": _share(nulls[n], total),
            "null_ratio": nulls[n] / max(total, 1),
            "present": total - nulls[n],
            "unique_count": unique[n],
            "unique_pct": _share(unique[n], total),
            "unique_ratio": unique[n] / max(total, 1),
        }
        if kind == "numeric":
            s, q = stats[n], quartiles[n]
            c.update(
                mean=round_half_up(s["mean"], 6),
                std=round_half_up(s["std"], 6),
                min=s["min"],
                max=s["max"],
                q25=q[0],
                median=q[1],
                q75=q[2],
                skewness=round_half_up(s["skewness"], 4),
                kurtosis=round_half_up(s["kurtosis"], 4),
                iqr_lower=round_half_up(limits[n][0], 6),
                iqr_upper=round_half_up(limits[n][1], 6),
                outlier_count=outliers[n],
                outlier_pct=_share(outliers[n], total),
                outlier_ratio=outliers[n] / max(total, 1),
                raw_skewness=s["skewness"],
            )
        elif kind == "categorical":
            best = next((t for t in tops if t[0] == n and t[3] == 1), None)
            c.update(
                top_value=best[1] if best else None,
                top_freq=best[2] if best else 0,
                top_freq_pct=_share(best[2], total) if best else 0.0,
            )
        columns[n] = c
    return Profile(df.sparkSession, types, total, copies, columns, tops)


def column_profile(df: DataFrame, types: ColumnTypes | None = None) -> DataFrame:
    return profile(df, types).column_frame()


def column_stats_table(p: Profile) -> DataFrame:
    """The display table: type, nulls, distinct values and the main statistics per column."""
    return p.column_frame().select(
        "column", "kind", "dtype", "null_count", "null_pct", "unique_count", "mean", "std",
        "min", "max", "skewness", "kurtosis", "outlier_count", "top_value",
    )


def eda_stats(p: Profile) -> DataFrame:
    return (
        p.column_frame()
        .where((F.col("kind") == "numeric") & (F.col("present") > 0))
        .select("column", "skewness", "kurtosis", "outlier_pct")
    )


def column_health(p: Profile) -> DataFrame:
    """0-100 per column from nulls, outliers and constancy, worst first, with the reasons."""
    nulls, outliers = F.col("null_pct"), F.coalesce(F.col("outlier_pct"), F.lit(0.0))
    constant = (F.col("unique_pct") < 0.5) & (F.col("unique_count") < 2)
    score = (
        F.lit(100.0)
        - F.least(nulls * 2, F.lit(50.0))
        - F.least(outliers * 1.5, F.lit(30.0))
        - F.when(constant, 20.0).otherwise(0.0)
    )
    issues = F.array(
        F.when(nulls > 0, F.concat(F.format_string("%.1f", nulls), F.lit("% missing"))),
        F.when(outliers > 0, F.concat(F.format_string("%.1f", outliers), F.lit("% outliers"))),
        F.when(constant, F.lit("near-constant")),
    )
    return (
        p.column_frame()
        .select(
            "column",
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("health_score"),
            F.filter(issues, lambda i: i.isNotNull()).alias("issues"),
            "null_pct",
            outliers.alias("outlier_pct"),
        )
        .orderBy("health_score", "column")
    )


def columns_with_issues(p: Profile) -> DataFrame:
    """Columns that have nulls, or are numeric and have outliers."""
    return (
        p.column_frame()
        .where((F.col("null_count") > 0) | (F.coalesce(F.col("outlier_count"), F.lit(0)) > 0))
        .select("column", "kind", "null_count", F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"))
    )
