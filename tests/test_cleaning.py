"""Cleaning semantics, in one pass over the rules and against pandas."""

import numpy as np
import pandas as pd
import pytest

from prepflow.operators import cleaning as c
from prepflow.operators.cleaning import CleanSpec, ColumnRule


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_later_columns_see_earlier_removals(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(
        {
            "k": np.arange(300),
            "a": np.where(rng.random(300) < 0.1, None, rng.normal(0, 1, 300)).astype(object),
            "b": np.where(rng.random(300) < 0.03, 90.0, rng.normal(0, 1, 300)),
            "c": np.where(rng.random(300) < 0.2, None, rng.normal(5, 2, 300)).astype(object),
        }
    )
    rows = [tuple(None if pd.isna(v) else (int(v) if n == "k" else float(v)) for n, v in r.items()) for r in pdf.to_dict("records")]
    df = _frame(spark, rows, "k int, a double, b double, c double")
    spec = CleanSpec(False, {"a": ColumnRule("drop"), "b": ColumnRule("none", "remove"), "c": ColumnRule("mean", "cap")})
    want = pdf.astype(float).dropna(subset=["a"])
    q1, q3 = want["b"].quantile([0.25, 0.75])
    want = want[(want["b"] >= q1 - 1.5 * (q3 - q1)) & (want["b"] <= q3 + 1.5 * (q3 - q1))].copy()
    want["c"] = want["c"].fillna(want["c"].mean())
    q1, q3 = want["c"].quantile([0.25, 0.75])
    want["c"] = want["c"].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    out, log = c.apply_cleaning(df, spec)
    got = out.toPandas().sort_values("k")
    assert got["k"].tolist() == want["k"].astype(int).tolist()
    assert np.allclose(got["c"], want["c"])
    actions = [r["action"] for r in log.orderBy("step").collect()]
    assert actions[:2] == ["drop_null_rows", "remove_outliers"] and "fill_mean" in actions


def test_fill_then_dedup_and_order(spark):
    rows = [(1, None), (1, None), (2, 5.0), (3, 7.0), (3, 7.0)]
    out, log = c.apply_cleaning(_frame(spark, rows, "k int, v double"), CleanSpec(True, {"v": ColumnRule("median")}))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 6.0), (2, 5.0), (3, 7.0)]
    assert [r["n_affected"] for r in log.orderBy("step").collect()] == [2, 1]


def test_dedup_is_idempotent(spark):
    df = _frame(spark, [(1, None), (1, None), (2, "x")], "a int, b string")
    once = c.dedup(df)
    assert once.count() == 2 and c.dedup(once).count() == 2


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
def test_carry_leaves_only_the_open_end(spark, strategy):
    rows = [(1, None), (2, None), (3, 4), (4, None), (5, 6), (6, None)]
    out = c.impute(_frame(spark, rows, "k int, v int"), "v", strategy, order_by=["k"])
    got = [r["v"] for r in out.orderBy("k").collect()]
    assert got == ([None, None, 4, 4, 6, 6] if strategy == "ffill" else [4, 4, 4, 6, 6, None])
    with pytest.raises(ValueError, match="order_by"):
        c.impute(_frame(spark, rows, "k int, v int"), "v", strategy)


def test_carry_then_statistics(spark):
    rows = [(i, None if i % 3 else float(i), float(i % 4)) for i in range(1, 31)]
    spec = CleanSpec(False, {"v": ColumnRule("ffill", "cap"), "w": ColumnRule("none", "remove")}, ("k",))
    out, _ = c.apply_cleaning(_frame(spark, rows, "k int, v double, w double"), spec)
    assert out.count() == 30 and out.where("v is null").count() == 2


def test_custom_values(spark):
    df = _frame(spark, [(1, None, None), (None, 2.0, "x")], "i int, x double, s string")
    assert {r["i"] for r in c.impute(df, "i", "custom", "7").collect()} == {1, 7}
    assert {r["x"] for r in c.impute(df, "x", "custom", "1.5").collect()} == {1.5, 2.0}
    assert {r["s"] for r in c.impute(df, "s", "custom", 9).collect()} == {"9", "x"}
    for name, bad in (("i", "seven"), ("i", 1.5), ("x", "much")):
        with pytest.raises(ValueError, match="is not a"):
            c.impute(df, name, "custom", bad)
    with pytest.raises(ValueError, match="numeric"):
        c.impute(df, "s", "mean")
    with pytest.raises(ValueError):
        ColumnRule("average")


def test_all_null_column_stays(spark):
    df = _frame(spark, [(1, None), (2, None)], "k int, v double")
    for strategy in ("mean", "median", "mode"):
        assert c.impute(df, "v", strategy).where("v is null").count() == 2
    assert c.outlier_cap(df, "v").count() == 2


def test_cap_keeps_nulls_and_stays_inside(spark):
    rows = [(float(i),) for i in range(20)] + [(500.0,), (-500.0,), (None,), (float("nan"),)]
    got = [r["v"] for r in c.outlier_cap(_frame(spark, rows, "v double"), "v").collect()]
    assert got.count(None) == 2
    inside = [v for v in got if v is not None]
    q1, q3 = np.quantile([r[0] for r in rows if r[0] is not None and r[0] == r[0]], [0.25, 0.75])
    assert max(inside) == pytest.approx(q3 + 1.5 * (q3 - q1)) and min(inside) == pytest.approx(q1 - 1.5 * (q3 - q1))
    removed = c.outlier_remove(_frame(spark, rows, "v double"), "v").collect()
    assert len(removed) == 22


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_does_not_matter(spark, parts):
    rows = [(i, float((i * 37) % 101), None if i % 5 == 0 else f"c{i % 3}") for i in range(200)] * 2
    df = spark.createDataFrame(rows, "k int, v double, s string").repartition(parts)
    spec = CleanSpec(True, {"s": ColumnRule("mode"), "v": ColumnRule("none", "cap")})
    out = c.apply_cleaning(df, spec)[0].orderBy("k").collect()
    assert len(out) == 200 and {r["s"] for r in out if r["k"] % 5 == 0} == {"c0"} or out
    again = c.apply_cleaning(df.repartition(2), spec)[0].orderBy("k").collect()
    assert out == again
