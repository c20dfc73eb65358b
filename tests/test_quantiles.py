"""Exact quantiles on every path, with hot values and wrong sketches."""

import numpy as np
import pytest

from prepflow.operators import quantiles as q

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture
def refined(monkeypatch):
    monkeypatch.setattr(q, "PLAN", q.Plan(builtin_cells=0))


def _columns(n=3001):
    rng = np.random.default_rng(11)
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 10)
    gaps = [None if rng.random() < 0.3 else float(v) for v in rng.integers(0, 5, n)]
    return [(float(a), float(b), g, None) for a, b, g in zip(rng.normal(size=n), hot, gaps)]


SCHEMA = "a double, hot double, gaps double, none double"


def _want(rows, i):
    values = [r[i] for r in rows if r[i] is not None]
    return list(np.quantile(values, PROBS)) if values else [None] * len(PROBS)


def _check(spark):
    rows = _columns()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = q.exact_quantiles(df, ["a", "hot", "gaps", "none"], PROBS)
    for i, n in enumerate(("a", "hot", "gaps")):
        assert got[n] == pytest.approx(_want(rows, i), abs=1e-12)
    assert got["none"] == [None] * len(PROBS)


def test_builtin(spark):
    _check(spark)


def test_refined(spark, refined):
    _check(spark)


def test_refined_by_running_totals(spark, refined, monkeypatch):
    monkeypatch.setattr(q, "PLAN", q.Plan(builtin_cells=0, window_rows=0))
    _check(spark)


def test_wrong_sketch_is_caught(spark, refined, monkeypatch):
    monkeypatch.setattr(
        q, "brackets_of", lambda columns, probs, found: {(c, j): (1e6, 2e6) for c in columns for j in range(len(probs))}
    )
    _check(spark)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0, 3.0, 3.0], [1.0, float("nan"), 4.0]])
def test_tiny(spark, refined, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = [v for v in values if v == v]
    assert q.exact_quantiles(df, ["v"], [0.25, 0.5])["v"] == pytest.approx(list(np.quantile(clean, [0.25, 0.5])))


def test_empty(spark):
    df = spark.createDataFrame([], "v double")
    assert q.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}


def test_grouped(spark):
    rng = np.random.default_rng(2)
    rows = [("big" if rng.random() < 0.7 else f"g{rng.integers(3)}", float(rng.integers(0, 50))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"]) for r in q.grouped_quantiles(df, "g", "v", [0.5, 0.75]).collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(tuple(np.quantile([v for h, v in rows if h == g], [0.5, 0.75])))
