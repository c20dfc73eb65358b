"""Data-quality rules over a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.functions.columns import aggregate, col, local_frame, numeric_columns, round_half_up
from prepflow.operators.correlation import pair_correlations
from prepflow.operators.frequency import union_all
from prepflow.operators.profile import Profile
from prepflow.session import together
from prepflow.sources.tables import DECIMAL

# fixed values
ID_RATIO = 0.95
HIGH_CORRELATION = 0.95
SKEW_LIMIT = 1.5
MISSING_LIMIT = 0.5
NUMERIC_SHARE = 0.9
SCHEMA = "type string, severity string, column string, column2 string, value double, action string"


def _frame(p: Profile, rows: list[tuple]) -> DataFrame:
    return local_frame(p.spark, rows, SCHEMA)


def scan_id_columns(p: Profile) -> DataFrame:
    """Columns at least 95 % distinct."""
    rows = [
        ("id_columns", "warning", n, None, round_half_up(c["unique_ratio"], 4), "drop")
        for n, c in p.columns.items()
        if c["unique_ratio"] >= ID_RATIO
    ]
    return _frame(p, rows)


def scan_constant(p: Profile) -> DataFrame:
    """Columns with at most one distinct value."""
    rows = [
        ("constant_columns", "error", n, None, float(c["unique_count"]), "drop")
        for n, c in p.columns.items()
        if c["unique_count"] <= 1
    ]
    return _frame(p, rows)


def scan_high_corr(df: DataFrame, p: Profile) -> DataFrame:
    """Numeric pairs with |r| >= 0.95."""
    found = pair_correlations(df, numeric_columns(df))
    rows = [
        ("high_correlation", "info", a, b, round_half_up(abs(r), 3), "review")
        for (a, b), r in found.items()
        if a != b and r is not None and abs(r) >= HIGH_CORRELATION
    ]
    return _frame(p, rows)


def scan_skewed(p: Profile) -> DataFrame:
    """Numeric columns of more than 10 values with |skewness| over 1.5."""
    rows = [
        ("skewed_columns", "info", n, None, round_half_up(abs(c["raw_skewness"]), 2), "transform")
        for n, c in p.columns.items()
        if c["kind"] == "numeric" and c["present"] > 10 and abs(c["raw_skewness"] or 0.0) > SKEW_LIMIT
    ]
    return _frame(p, rows)


def scan_high_missing(p: Profile) -> DataFrame:
    """Columns more than half empty."""
    rows = [
        ("high_missing", "warning", n, None, round_half_up(c["null_ratio"] * 100, 1), "drop")
        for n, c in p.columns.items()
        if c["null_ratio"] > MISSING_LIMIT
    ]
    return _frame(p, rows)


def scan_numeric_strings(df: DataFrame, p: Profile) -> DataFrame:
    """Text columns where over 90 % of all rows read as a number."""
    names = [n for n in p.types.categorical if p.columns[n]["dtype"] == "string"]
    trimmed = [F.trim(col(n)) for n in names]
    counts = aggregate(df, [F.count(F.when(c.rlike(DECIMAL), c.try_cast("double"))) for c in trimmed])
    shares = {n: k / max(p.n_rows, 1) for n, k in zip(names, counts)}
    rows = [
        ("numeric_strings", "warning", n, None, round_half_up(share, 4), "convert")
        for n, share in shares.items()
        if share > NUMERIC_SHARE
    ]
    return _frame(p, rows)


def smart_scan(df: DataFrame, p: Profile) -> DataFrame:
    """All six rules, in order."""
    related, numbers = together(
        p.spark, lambda: scan_high_corr(df, p), lambda: scan_numeric_strings(df, p)
    )
    found = [scan_id_columns(p), scan_constant(p), related, scan_skewed(p), scan_high_missing(p), numbers]
    return union_all(found)
