"""Chart data and correlation against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from prepflow.operators import correlation as co
from prepflow.operators import eda


def _numbers(n=400, p=5, gaps=True):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 100
    x[:, 0] = rng.integers(0, 4, n)
    if gaps:
        x[rng.random((n, p)) < 0.1] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(p)])


def _df(spark, pdf):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)


def _matrix(frame, digits=10):
    out = frame.toPandas().pivot(index="col_a", columns="col_b", values="r")
    return out.to_numpy(float)


@pytest.mark.parametrize("limit", [16, 0])
def test_pearson_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(co, "SUMMED_COLUMNS", limit)
    pdf = _numbers()
    pdf["z"] = 3.0
    got = _matrix(co.corr_pearson(_df(spark, pdf), digits=None))
    assert np.allclose(got[:5, :5], pdf.iloc[:, :5].corr().to_numpy())
    assert np.isnan(got[5]).all()


def test_spearman_of_thirty_columns_with_gaps(spark, monkeypatch):
    """Every pair on its own complete rows, with ties, an empty and a constant column."""
    monkeypatch.setattr(co, "RANK_ROWS", 37)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 1))
    values = np.round(base * rng.normal(size=30) + rng.normal(size=(400, 30)), 1)
    values[rng.random(values.shape) < np.linspace(0.0, 0.5, 30)] = np.nan
    values[:, 28], values[:, 29] = np.nan, np.where(np.isnan(values[:, 29]), np.nan, 2.0)
    pdf = pd.DataFrame(values, columns=[f"x{i:02d}" for i in range(30)])
    got = _matrix(co.corr_spearman(_df(spark, pdf), digits=None).orderBy("i", "j"))
    want = pdf.corr("spearman").to_numpy()
    want[28, 28] = want[29, 29] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_spearman(spark):
    pdf = _numbers(p=3)
    pdf["full"] = np.round(np.random.default_rng(1).normal(size=len(pdf)), 1)
    pdf["full2"] = pdf["full"] ** 2
    got = _matrix(co.corr_spearman(_df(spark, pdf), digits=None).orderBy("i", "j"))
    want = pdf.corr("spearman").sort_index().sort_index(axis=1).to_numpy()
    assert np.allclose(got, want)


def test_target_corr_bands(spark):
    x = np.arange(50.0)
    pdf = pd.DataFrame({"t": x, "same": x * 2, "flat": x * 0, "noise": np.random.default_rng(0).normal(size=50)})
    got = {r["column"]: r["band"] for r in co.target_corr(_df(spark, pdf), "t").collect()}
    assert got["same"] == "strong" and "flat" not in got


def test_pca_many_columns(spark):
    pdf = _numbers(p=5)
    df = _df(spark, pdf)
    fitted = eda.pca(df, target="x0")
    x = pdf.drop(columns="x0")
    x = x.fillna(x.median())
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:3])
    got = fitted.scores(df, ["x1"]).toPandas()
    for k in range(3):
        lead = np.abs(vt[k]).argmax()
        want = z @ (vt[k] * np.sign(vt[k][lead]))
        assert np.allclose(np.sort(got[f"PC{k + 1}"]), np.sort(want))


def test_pca_with_constant_column(spark):
    pdf = pd.DataFrame({"a": np.arange(10.0), "b": np.arange(10.0)[::-1], "c": 4.0})
    fitted = eda.pca(_df(spark, pdf))
    assert fitted.explained[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="at least 2"):
        eda.pca(_df(spark, pdf[["a"]]))


def test_kde_and_histogram(spark):
    x = np.random.default_rng(3).gamma(2, size=500).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    got = eda.kde(df, "v").orderBy("point").toPandas()
    grid, h = np.linspace(x.min(), x.max(), 300), 500**-0.2 * x.std(ddof=1)
    dens = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (h * np.sqrt(2 * np.pi))
    bins = eda.bin_count(500)
    assert bins == 22
    assert np.allclose(got["x"], grid) and np.allclose(got["y"], dens * (x.max() - x.min()) / bins)
    hist = eda.histogram(df, "v").orderBy("bin").toPandas()
    assert hist["count"].sum() == 500 and len(hist) == 22
    assert hist["count"].tolist() == np.histogram(x, bins=22)[0].tolist()


def test_flat_and_empty(spark):
    flat = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert eda.histogram(flat, "v").orderBy("bin").first()["count"] == 5
    assert eda.kde(flat, "v").count() == 0
    empty = flat.where("v > 3")
    assert eda.histogram(empty, "v").count() == 0
    assert eda.box_stats(empty, "v").first()["outliers"] == 0
    assert eda.violin_stats(empty, "v").where("part = 'density'").count() == 0


def test_grouped_violin_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.8, "hot", "cold"), "v": rng.normal(size=900).round(2)})
    got = eda.grouped_violin(spark.createDataFrame(pdf), "v", "g").toPandas()
    for g, part in pdf.groupby("g"):
        rows = got[(got["group"] == g) & (got["part"] == "summary")].set_index("label")["x"]
        assert rows["median"] == pytest.approx(part["v"].median()) and rows["mean"] == pytest.approx(part["v"].mean())
        assert (got[(got["group"] == g)]["part"] == "density").sum() == 300


def test_rollup_counts(spark):
    rows = [("a", "x", 1.0)] * 3 + [("a", "y", 2.0), ("b", "x", 4.0), (None, "x", 9.0)]
    got = {(r[0], r[1]): r["total"] for r in eda.hierarchy_rollup(spark.createDataFrame(rows, "p string, q string, v double"), ["p", "q"]).collect()}
    assert got == {("a", "x"): 3, ("a", "y"): 1, ("b", "x"): 1, ("a", None): 4, ("b", None): 1}


@pytest.mark.parametrize("spread", ["normal", "far", "two"])
def test_density_against_every_kernel(spark, spread):
    """Moments of boxes give the sums of kernels that the rows give."""
    rng = np.random.default_rng(4)
    v = {
        "normal": rng.normal(5, 2, 700),
        "far": np.append(rng.normal(size=700), [1e4, -1e4]),  # most grid points are near no value
        "two": np.array([1.0, 2.0, 2.0]),
    }[spread]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = eda.kde(df, "v").orderBy("point").toPandas()
    grid = np.linspace(v.min(), v.max(), 300)
    h = len(v) ** -0.2 * v.std(ddof=1)
    width = (v.max() - v.min()) / eda.bin_count(len(v))
    want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) * width / (h * np.sqrt(2 * np.pi))
    assert len(got) == 300 and np.allclose(got["x"], grid)
    assert np.abs(got["y"] - want).max() < 1e-11 * want.max()


def test_densities_of_groups_without_spread(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", float("inf")), ("c", 1.0), ("d", None), ("f", 1.0), ("f", 3.0)]
    found = eda.grouped_violin(spark.createDataFrame(rows, "g string, v double"), "v", "g").where("part = 'density'")
    assert {r["group"]: r["count"] for r in found.groupBy("group").count().collect()} == {"f": 300}


@pytest.mark.parametrize("frequent", [2, 256])
def test_rows_of_a_common_value_do_not_meet_in_one_task(spark, monkeypatch, frequent):
    """One task sorted all rows that hold the same value."""
    from prepflow.operators import correlation

    monkeypatch.setattr(correlation, "FREQUENT", frequent)
    sizes, ranked = [], correlation._ranked

    def spied(*given):
        out = ranked(*given)
        sizes.extend(out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return out

    monkeypatch.setattr(correlation, "_ranked", spied)
    rng = np.random.default_rng(4)
    a = np.where(rng.random(4000) < 0.9, 1.0, rng.integers(0, 50, 4000).astype(float))
    frame = pd.DataFrame({"a": a, "b": a + rng.normal(size=4000), "c": rng.integers(0, 9, 4000).astype(float)})
    for k, c in enumerate(frame.columns):
        frame.loc[rng.random(4000) < 0.1 * (k + 1), c] = np.nan
    cells = [tuple(None if v != v else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(cells, "a double, b double, c double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation.corr_spearman(df, digits=None).collect()}
    for x in frame:
        for y in frame:
            both = frame[[x, y]].dropna() if x != y else frame[[x]].dropna()
            want = both[x].rank().corr(both[y].rank()) if x != y else 1.0
            assert abs(found[x, y] - want) < 1e-9
    if frequent == 256:
        assert max(sizes) < 0.9 * 0.9 * 4000 and len([s for s in sizes if s]) > 1


def test_ranks_travel_as_packed_lists_of_distinct_values(spark, monkeypatch):
    """Every row sent its values and got a list of ranks for each of them, which took hundreds of bytes of disk a row."""
    monkeypatch.setattr(co, "PIECE", 2000)
    monkeypatch.setattr(co, "RANK_ROWS", 1000)
    sent, ranked = [], co._ranked

    def spied(*given):
        out = ranked(*given)
        sent.extend(len(r["ranks"]) for r in out.collect())
        return out

    monkeypatch.setattr(co, "_ranked", spied)
    rng = np.random.default_rng(9)
    n = 6000
    a = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)
    b = np.round(np.sign(a) + rng.normal(size=n), 1) * np.where(rng.random(n) < 0.5, 1.0, -1.0)
    frame = pd.DataFrame({"a": a, "b": b, "c": rng.integers(0, 9, n).astype(float), "d": np.nan})
    frame.loc[:20, "a"], frame.loc[20:40, "a"] = np.inf, -np.inf
    for k, c in enumerate(("a", "b", "c")):
        frame.loc[rng.random(n) < 0.1 * (k + 1), c] = np.nan
    assert (frame["b"] == 0).any() and np.signbit(frame["b"][frame["b"] == 0]).nunique() == 2
    found = {(r["col_a"], r["col_b"]): r["r"] for r in co.corr_spearman(_df(spark, frame), digits=None).collect()}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = frame[[x, y]].dropna()
        assert abs(found[x, y] - both[x].rank().corr(both[y].rank())) < 1e-12
    assert found["a", "d"] is None and found["d", "d"] is None and found["c", "c"] == 1.0
    assert 3 < len(sent) < 100 and sum(sent) < 8 * n
