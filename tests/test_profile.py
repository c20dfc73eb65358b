"""Profile, typing and rule edge cases."""

import math

import pandas as pd
import pytest

from prepflow.operators import frequency, profile, scan, types
from prepflow.operators.cleaning import auto_clean_spec


def _mixed(spark):
    rows = [(1, 2.0, 5, "x", True, "2024-01-0%d" % (i + 1), None, f"id{i}") for i in range(6)]
    rows += [(2, float("nan"), 5, None, None, None, None, "id6"), (3, None, 5, "y", False, "2024-02-01", None, "id7")]
    schema = "a int, b double, const int, cat string, flag boolean, day string, void string, code string"
    return spark.createDataFrame(rows, schema)


def test_types(spark):
    t = types.detect_column_types(_mixed(spark))
    assert t.numeric == ("a", "b", "const")
    assert t.datetime == ("day",)
    assert t.boolean == ("flag",)
    assert t.categorical == ("cat", "void", "code")


def test_strings_that_are_not_dates(spark):
    df = spark.createDataFrame([("2020", "12", "1/2/2024", "x" * 90)], "year string, n string, us string, long string")
    t = types.detect_column_types(df)
    assert t.categorical == ("year", "n") and t.datetime == ("us",) and t.text == ("long",)


def test_nested_columns_are_refused(spark):
    with pytest.raises(TypeError, match="flatten"):
        types.detect_column_types(spark.createDataFrame([([1],)], "a array<int>"))


def test_profile_counts(spark):
    from prepflow.functions.columns import nan_to_null

    p = profile.profile(nan_to_null(_mixed(spark)))
    assert p.n_rows == 8 and p.duplicate_rows == 0
    assert p.columns["b"]["null_count"] == 2 and p.columns["b"]["present"] == 6
    assert p.columns["b"]["skewness"] == 0.0 and p.columns["b"]["std"] == 0.0
    assert p.columns["void"]["unique_count"] == 0 and p.columns["void"]["top_value"] is None
    health = {r["column"]: r["health_score"] for r in profile.column_health(p).collect()}
    assert health["void"] == 30.0  # all null: -50, and no two values: -20
    assert [r["column"] for r in scan.scan_constant(p).collect()] == ["b", "const", "void"]


@pytest.mark.parametrize("values", [[], [4.0], [1.0, 5.0], [1.0, 5.0, 2.0], [1.0, 5.0, 2.0, 9.0], [1e9 + i % 3 for i in range(50)]])
def test_moments_like_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = profile.moments(df, ["v"])["v"]
    s = pd.Series(values, dtype=float) - (values[0] if values else 0.0)  # same moments, fewer digits lost
    for key, want in (("std", s.std()), ("skewness", s.skew()), ("kurtosis", s.kurt())):
        if math.isnan(want):
            assert got[key] is None
        else:
            assert got[key] == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    row = profile.table_profile(df).first()
    assert (row["n_rows"], row["duplicate_rows"], row["null_pct"], row["quality_score"]) == (0, 0, 0.0, 100.0)
    p = profile.profile(df)
    assert p.columns["a"]["outlier_count"] == 0 and p.columns["b"]["top_freq"] == 0


@pytest.mark.parametrize("copies", [1, 3, 200])
def test_duplicates_both_ways(spark, copies, monkeypatch):
    # few copies take the path through suspects, many the full comparison
    rows = [(i, float(i % 7), None if i % 3 else "t") for i in range(300)] + [(1, 1.0, None)] * copies
    df = spark.createDataFrame(rows, "a int, b double, c string").repartition(4)
    want = pd.DataFrame(rows).duplicated().sum()
    assert profile.count_duplicates(df) == (300 + copies, want)


def test_duplicates_with_colliding_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from prepflow.operators import duplicates

    monkeypatch.setattr(duplicates, "row_key", lambda df: F.lit(1).cast("bigint"))
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "a int")
    assert profile.count_duplicates(df) == (4, 1)
    monkeypatch.setattr(duplicates, "SUSPECT_SHARE", 1.0)
    assert profile.count_duplicates(df) == (4, 1)


def test_minus_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert profile.count_duplicates(df) == (2, 1)


def test_modes(spark):
    import datetime as dt

    rows = [(3, "b", True, dt.date(2024, 1, 2), 2.5), (1, "a", None, dt.date(2024, 1, 1), 2.5), (3, "a", False, None, 1.0)]
    rows += [(1, "b", False, None, None)]
    df = spark.createDataFrame(rows, "i int, s string, f boolean, d date, x double")
    got = frequency.modes(df, ["i", "s", "f", "d", "x"])
    assert got == {"i": 1, "s": "a", "f": False, "d": dt.date(2024, 1, 1), "x": 2.5}


def test_distinct_counts_many_types(spark):
    from decimal import Decimal

    rows = [(1, Decimal("1.10"), float("nan"), b"x"), (1, Decimal("1.1"), 2.0, b"y"), (2, None, 2.0, b"z")]
    df = spark.createDataFrame(rows, "a int, d decimal(5,2), x double, raw binary")
    assert frequency.distinct_counts(df) == {"a": 2, "d": 1, "x": 1}
    assert frequency.distinct_counts(df, ["a"], approx=True) == {"a": 2}


def test_auto_clean_spec(spark):
    rows = [(float(i % 5), 1000.0 if i == 0 else float(i % 3), None if i % 4 == 0 else "x", None if i == 1 else True) for i in range(100)]
    rows += [(None, None, "y", False)]
    spec = auto_clean_spec(profile.profile(spark.createDataFrame(rows, "a double, b double, c string, d boolean")))
    chosen = {n: (r.null_strategy, r.outlier_strategy) for n, r in spec.columns.items()}
    assert chosen == {"a": ("mean", "keep"), "b": ("median", "cap"), "c": ("mode", "keep"), "d": ("mode", "keep")}


def test_numeric_strings(spark):
    rows = [("1", "1f", "0x1", "1.5e3", " 7 ")] * 19 + [(None, "2", "3", "4", "5")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    found = scan.scan_numeric_strings(df, profile.profile(df)).collect()
    assert [r["column"] for r in found] == ["a", "d", "e"]


def test_profile_by_brackets_is_the_profile(spark, sf_dir, monkeypatch):
    """Sketch, proof and gathering give what the built-in percentile gives."""
    from prepflow.operators import quantiles

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = profile.column_profile(df).collect()
    monkeypatch.setattr(quantiles, "PLAN", quantiles.Plan(builtin_cells=0))
    assert profile.column_profile(df).collect() == want


def test_counts_and_tops(spark):
    """Kinds of value do not mix, and ties of top values go to the smaller one."""
    rows = [(1, 1.0, "1", True, None), (1, -0.0, "b", True, None), (2, 0.0, "b", None, None), (None, float("nan"), None, False, None), (3, 2.5, "a", True, None), (3, 2.5, "a", True, None)]
    df = spark.createDataFrame(rows, "i int, d double, t string, b boolean, n string").selectExpr("*", "date_add(date'2024-01-01', i) as day", "cast(i as decimal(9, 2)) as m", "timestamp_seconds(i) as s")
    counts, tops = frequency.counts_and_tops(df, df.columns, ["t", "n"], 2)
    assert counts == {"i": 3, "d": 3, "t": 3, "b": 2, "n": 0, "day": 3, "m": 3, "s": 3}
    assert sorted(tops) == [("t", "a", 2, 1), ("t", "b", 2, 2)]
    assert frequency.counts_and_tops(df, [], [], 2) == ({}, [])
