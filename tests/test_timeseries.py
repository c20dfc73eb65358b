"""Series operators against pandas and direct least squares."""

import math

import numpy as np
import pandas as pd
import pytest

from prepflow.operators import ordering
from prepflow.operators import timeseries as ts


@pytest.fixture(params=[60_000, 64])
def chunked(request, monkeypatch):
    """Once in one chunk, once cut into many."""
    monkeypatch.setattr(ordering, "MIN_CHUNK", request.param)


def _walk(n=300, seed=8, kind="ar"):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    x = np.cumsum(e) if kind == "walk" else np.zeros(n)
    if kind == "ar":
        for i in range(1, n):
            x[i] = 0.6 * x[i - 1] + e[i]
    return x + 10


def _series(spark, x, parts=3, keys=False):
    rows = [(i, f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}", float(v), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, d string, v double, k int").repartition(parts)
    return ts.prepare(df, "d", "v", ["id"], ["k"] if keys else ())


def _adf_by_hand(x):
    """The same test by least squares on explicit rows."""
    n = len(x)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def regress(k, start):
        t = np.arange(start, n)
        cols = [np.ones(len(t)), x[t - 1]] + [d[t - 1 - i] for i in range(1, k + 1)]
        z, y = np.column_stack(cols), d[t - 1]
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        ssr = float(((y - z @ beta) ** 2).sum())
        return beta, ssr, z, len(t)

    aic = []
    for k in range(top + 1):
        _, ssr, z, rows = regress(k, top + 1)
        aic.append(rows * (math.log(2 * math.pi) + math.log(ssr / rows) + 1) + 2 * z.shape[1])
    k = int(np.argmin(aic))
    beta, ssr, z, rows = regress(k, k + 1)
    se = math.sqrt(ssr / (rows - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    return beta[1] / se, k, rows


@pytest.mark.parametrize("kind,n", [("ar", 300), ("walk", 301), ("ar", 25)])
@pytest.mark.parametrize("chunk", [60_000, 64])
def test_adf(spark, kind, n, chunk):
    x = _walk(n, kind=kind)
    statistic, lags, rows = _adf_by_hand(x)
    got = ts.adf_test(_series(spark, x), chunk=chunk)
    assert got["lags_used"] == lags and got["n_obs"] == rows
    assert got["statistic"] == pytest.approx(statistic, rel=1e-7)
    assert got["is_stationary"] == (got["p_value"] < 0.05)


def test_adf_keyed(spark):
    x = _walk(240)
    series = _series(spark, x, keys=True)
    with pytest.raises(ValueError, match="adf_frame"):
        ts.adf_test(series)
    got = {r["k"]: r for r in ts.adf_frame(series, chunk=50).collect()}
    assert len(got) == 2
    for k in (0, 1):
        statistic, lags, rows = _adf_by_hand(x[k::2])
        assert (got[k]["lags_used"], got[k]["n_obs"]) == (lags, rows)
        assert got[k]["statistic"] == pytest.approx(statistic, rel=1e-7)


def test_adf_keyed_short_and_constant(spark):
    rows = [("a", i, float(i * i % 17)) for i in range(40)] + [("b", i, 1.0) for i in range(40)] + [(None, 0, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double").selectExpr("k", "i", "v", "timestamp_seconds(i) t")
    got = {r["k"]: r["statistic"] for r in ts.adf_frame(ts.prepare(df, "t", "v", ["i"], ["k"])).collect()}
    assert got["a"] is not None and got["b"] is None and got[None] is None and len(got) == 3


def test_adf_table_values():
    for statistic, p in ((-2.86154, 0.05), (-3.43035, 0.01), (-2.56677, 0.10)):
        assert ts.adf_p_value(statistic) == pytest.approx(p, abs=5e-4)
    assert ts.adf_p_value(3.0) == 1.0 and ts.adf_p_value(-20.0) == 0.0
    assert ts.adf_critical(10**9)["5%"] == pytest.approx(-2.86154, abs=1e-5)


def test_adf_refuses(spark):
    with pytest.raises(ValueError, match="constant"):
        ts.adf_test(_series(spark, [1.0] * 30))
    with pytest.raises(ValueError, match="short"):
        ts.adf_test(_series(spark, [1.0, 2.0, 4.0]))


def test_rolling(spark, chunked):
    x = pd.Series(_walk(200))
    got = ts.rolling(_series(spark, x), (7, 14, 500)).toPandas().sort_values("idx")
    for w in (7, 14):
        assert np.allclose(got[f"mean_{w}"], x.rolling(w, center=True).mean(), equal_nan=True)
        assert np.allclose(got[f"std_{w}"], x.rolling(w, center=True).std(), equal_nan=True)
        assert np.allclose(got[f"min_{w}"], x.rolling(w).min(), equal_nan=True)
        assert np.allclose(got[f"max_{w}"], x.rolling(w).max(), equal_nan=True)
    assert got["mean_500"].isna().all()


def test_window_as_long_as_the_series(spark):
    x = pd.Series(_walk(14))
    series = _series(spark, x)
    assert ts.ts_line(series, 14).where("mean_14 is not null").count() == 0
    panel = ts.ts_rolling_panel(series, 14).where("mean_14 is not null").collect()
    assert len(panel) == 1 and panel[0]["mean_14"] == pytest.approx(x.mean())


def test_autocorr(spark, chunked):
    x = pd.Series(_walk(150))
    got = {r["lag"]: r["autocorr"] for r in ts.autocorr_lags(_series(spark, x), 14).collect()}
    assert got == {k: pytest.approx(x.autocorr(k), abs=6e-5) for k in range(1, 15)}
    ordered = [abs(r["autocorr"]) for r in ts.autocorr_lags(_series(spark, x), 14).collect()]
    assert ordered == sorted(ordered, reverse=True)
    short = ts.autocorr_lags(_series(spark, x[:9]), 14).collect()
    assert sorted(r["lag"] for r in short) == [1, 2, 3]
    assert ts.autocorr_lags(_series(spark, [2.0] * 20), 3).count() == 0


def test_autocorr_keyed(spark):
    x = pd.Series(_walk(100))
    got = ts.autocorr_lags(_series(spark, x, keys=True), 3).collect()
    for r in got:
        assert r["autocorr"] == pytest.approx(x[x.index % 2 == r["k"]].autocorr(r["lag"]), abs=6e-5)
    assert len(got) == 6


def test_lag_strength_keyed(spark):
    x = pd.Series(_walk(100))
    lags = ts.autocorr_lags(_series(spark, x, keys=True), 7)
    got = ts.lag_strength(lags, 3, ["k"]).collect()
    for k in (0, 1):
        want = sorted((r["lag"] for r in lags.collect() if r["k"] == k), key=lambda g: -abs(x[k::2].reset_index(drop=True).autocorr(g)))
        assert [r["lag"] for r in sorted(got, key=lambda r: -abs(r["autocorr"])) if r["k"] == k] == want[:3]


def _decompose_by_hand(x, m):
    n = len(x)
    weights = np.r_[0.5, np.ones(m - 1), 0.5] / m if m % 2 == 0 else np.ones(m) / m
    h = m // 2
    trend = np.full(n, np.nan)
    trend[h : n - h] = np.convolve(x, weights, "valid")
    front, back = h, n - 1 - h
    last, first = min(front + m, back), max(front, back - m)
    k, c = np.polyfit(np.arange(front, last), trend[front:last], 1)
    trend[:front] = np.arange(front) * k + c
    k, c = np.polyfit(np.arange(first, back), trend[first:back], 1)
    trend[back + 1 :] = np.arange(back + 1, n) * k + c
    rest = x - trend
    means = np.array([rest[i::m].mean() for i in range(m)])
    season = np.resize(means - means.mean(), n)
    return trend, season, rest - season


@pytest.mark.parametrize("m,n", [(4, 40), (7, 200), (12, 150), (2, 10)])
def test_decompose(spark, chunked, m, n):
    x = _walk(n) + np.sin(np.arange(n) * 2 * np.pi / m)
    got = ts.decompose(_series(spark, x), m).toPandas().sort_values("idx")
    for name, want in zip(("trend", "seasonal", "resid"), _decompose_by_hand(x, m)):
        assert np.allclose(got[name], want, atol=1e-9)
    assert np.allclose(got["trend"] + got["seasonal"] + got["resid"], x)


def test_decompose_keyed(spark, chunked):
    x = _walk(161) + np.sin(np.arange(161))
    got = ts.decompose(_series(spark, x, keys=True), 7).toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values("idx")
        for name, want in zip(("trend", "seasonal", "resid"), _decompose_by_hand(x[k::2], 7)):
            assert np.allclose(part[name], want, atol=1e-9)


def test_decompose_leaves_short_series_open(spark):
    rows = [(k, i, float(i % 5)) for k, n in (("a", 60), (None, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").selectExpr("k", "i", "v", "timestamp_seconds(i) t")
    got = ts.decompose(ts.prepare(df, "t", "v", ["i"], ["k"]), 5)
    assert got.count() == 69 and got.where("k is null and trend is null").count() == 9


def test_decompose_refuses(spark):
    with pytest.raises(ValueError, match="10 points"):
        ts.decompose(_series(spark, _walk(9)))
    with pytest.raises(ValueError, match="at least 60"):
        ts.decompose(_series(spark, _walk(50)), 30)


def test_decompose_ma(spark, chunked):
    x = pd.Series(_walk(120))
    got = ts.decompose_ma(_series(spark, x)).toPandas().sort_values("idx")
    trend = x.rolling(12, center=True, min_periods=1).mean()
    season = (x - trend).rolling(12, center=True, min_periods=1).mean()
    assert np.allclose(got["trend"], trend) and np.allclose(got["seasonal"], season)


def test_trend_and_halves(spark):
    x = np.r_[_walk(50), 5 * _walk(50, seed=2)]
    series = _series(spark, x)
    row = ts.trend_slope(series).first()
    assert row["slope"] == pytest.approx(np.polyfit(np.arange(100), x, 1)[0], abs=1e-6)
    got = ts.variance_ratio(series).first()
    assert got["ratio"] == pytest.approx(x[50:].var(ddof=1) / (x[:50].var(ddof=1) + 1e-9))


def test_prepare_drops_what_is_missing(spark):
    rows = [("2024-01-02", 1.0, 1), ("bad", 2.0, 2), (None, 3.0, 3), ("2024-01-01", None, 4), ("2024-01-01", float("nan"), 5), ("2024-01-01", 9.0, 6)]
    series = ts.prepare(spark.createDataFrame(rows, "d string, v double, id int"), "d", "v", ["id"])
    assert [r["v"] for r in series.frame.orderBy("idx").collect()] == [9.0, 1.0] and series.n == 2


@pytest.mark.parametrize(
    "days,label",
    [([0, 0, 0, 5], "Hourly / Daily"), ([0, 3, 9], "Daily"), ([0, 14, 28], "Weekly"), ([0, 30, 61, 91], "Monthly"),
     ([0, 90, 181], "Quarterly"), ([0, 365, 730], "Yearly"), ([0, 1], "Unknown")],
)
def test_frequency(spark, days, label):
    dates = [(str((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)).date()),) for d in days] + [(None,)]
    df = spark.createDataFrame(dates, "d string").selectExpr("cast(d as date) d")
    row = ts.infer_frequency(df, "d").first()
    assert (row["n_dates"], row["frequency"]) == (len(days), label)


def test_summary_needs_points(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 1)], "d string, v double, id int")
    with pytest.raises(ValueError, match="need 5"):
        ts.ts_summary(df, "d", "v", ["id"])


def test_dates_are_counted_once(spark, monkeypatch):
    """Every reading of the positions grouped the whole table again."""
    read = []
    index = ts.index_rows
    monkeypatch.setattr(ts, "index_rows", lambda df, *a, **k: read.append(df) or index(df, *a, **k))
    rows = [(k, f"2024-01-{d:02d}") for k in ("a", None) for d in (1, 8, 8, 15, 22)] + [("b", "2024-01-01"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, d string").selectExpr("k", "cast(d as timestamp) d")
    found = {r["k"]: (r["n_dates"], r["median_days"], r["frequency"]) for r in ts.infer_frequency(df, "d", ["k"]).collect()}
    assert found == {"a": (5, 7, "Daily"), None: (5, 7, "Daily"), "b": (1, None, "Unknown")}
    assert "Aggregate" not in read[0]._jdf.queryExecution().optimizedPlan().toString()
