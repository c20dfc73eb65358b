"""Positions, frames, carries and running totals against pandas, whatever the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepflow.operators import ordering as o


def _table(n=400, seed=3):
    rng = np.random.default_rng(seed)
    # a third of the rows share one first sort key
    t = np.where(rng.random(n) < 0.34, 50, rng.integers(0, 100, n))
    return pd.DataFrame({"id": np.arange(n), "t": t, "k": rng.integers(0, 4, n), "v": rng.normal(size=n).round(3)})


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_index_rows(spark, parts, small, monkeypatch):
    if small:
        _small_buckets(monkeypatch)
    pdf = _table().sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf).repartition(parts)
    got = o.index_rows(df, ["t", "id"], count="n").toPandas().sort_values("idx")
    want = pdf.sort_values(["t", "id"])
    assert got["idx"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == want["id"].tolist()
    assert set(got["n"]) == {len(pdf)}


@pytest.mark.parametrize("small", [False, True])
def test_index_rows_keyed(spark, small, monkeypatch):
    if small:
        _small_buckets(monkeypatch)
    pdf = _table()
    got = o.index_rows(spark.createDataFrame(pdf), ["t", "id"], ["k"], count="n").toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values("idx")
        want = pdf[pdf["k"] == k].sort_values(["t", "id"])
        assert part["id"].tolist() == want["id"].tolist()
        assert part["idx"].tolist() == list(range(len(want)))
        assert set(part["n"]) == {len(want)}


def test_index_rows_null_key_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, id int")
    got = {(r["k"], r["id"]): r["idx"] for r in o.index_rows(df, ["id"], ["k"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 3): 0}
    assert o.index_rows(df.where("id > 9"), ["id"], count="n").count() == 0


@pytest.mark.parametrize("size", [7, 20, 1000])
def test_framed(spark, size):
    pdf = _table(150)
    indexed = o.index_rows(spark.createDataFrame(pdf), ["id"])
    columns = {
        "mean": o.Frame(3, 2, lambda w: F.avg("v").over(w)),
        "back": o.lagged(F.col("v"), 4),
        "ahead": o.Frame(0, 5, lambda w: F.lead("v", 5).over(w), unframed=True),
    }
    got = o.framed(indexed, columns, 150, size=size).toPandas().sort_values("idx")
    v = pdf["v"].tolist()
    mean = [np.mean(v[max(0, i - 3) : i + 3]) for i in range(150)]
    assert len(got) == 150
    assert np.allclose(got["mean"], mean)
    assert np.allclose(got["back"].astype(float), pdf["v"].shift(4), equal_nan=True)
    assert np.allclose(got["ahead"].astype(float), pdf["v"].shift(-5), equal_nan=True)


def test_halo_needs_room(spark):
    with pytest.raises(ValueError):
        o.with_halo(spark.range(3).withColumnRenamed("id", "idx"), 5, 0, 2)


def _small_buckets(monkeypatch):
    """Many uneven buckets for a small table: a search tree of several levels."""
    monkeypatch.setattr(o, "BUCKET_ROWS", 3)
    monkeypatch.setattr(o, "BUCKETS", 20)
    monkeypatch.setattr(o, "FAN", 3)


@pytest.mark.parametrize("small", [False, True])
def test_carry_fill(spark, small, monkeypatch):
    if small:
        _small_buckets(monkeypatch)
    pdf = _table(90)
    pdf["v"] = pdf["v"].where(np.random.default_rng(5).random(90) < 0.2)
    pdf["w"] = pdf["v"].where(np.random.default_rng(6).random(90) < 0.5)
    pdf.loc[:5, "v"] = None
    cells = lambda x: None if pd.isna(x) else float(x)
    rows = [(int(a), int(k), cells(v), cells(w)) for a, k, v, w in zip(pdf["id"], pdf["k"], pdf["v"], pdf["w"])]
    df = spark.createDataFrame(rows, "id int, k int, v double, w double").repartition(3)
    got = o.carry_fill(df, {"v": True, "w": False}, ["id"]).toPandas().sort_values("id")
    assert np.allclose(got["v"].astype(float), pdf["v"].ffill(), equal_nan=True)
    assert np.allclose(got["w"].astype(float), pdf["w"].bfill(), equal_nan=True)
    got = o.carry_fill(df, {"v": True, "w": False}, ["id"], ["k"]).toPandas().sort_values("id")
    assert np.allclose(got["v"].astype(float), pdf.groupby("k")["v"].ffill(), equal_nan=True)
    assert np.allclose(got["w"].astype(float), pdf.groupby("k")["w"].bfill(), equal_nan=True)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_next_values_are_found_in_one_reading(spark, keys):
    """A frame up to the end of the bucket is read anew for each row: quadratic in the rows of a bucket."""
    rows = [(0, 1, None), (1, 2, None), (0, 3, 7.0), (0, 4, None), (1, 5, 8.0), (0, 6, None), (1, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    out = o.carry_fill(df, {"v": False}, ["t"], keys, ranges=o.Ranges(("t",), [["2"], ["5"]]))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    got = {(r["k"], r["t"]): r["v"] for r in out.collect()}
    want = {(1, None): 7.0, (0, 1): 7.0, (1, 2): 7.0, (0, 3): 7.0, (0, 4): 8.0, (1, 5): 8.0, (0, 6): None}
    assert got == (want | {(1, None): 8.0, (1, 2): 8.0, (0, 4): None} if keys else want)


@pytest.mark.parametrize("n", [1, 5, 30, 200])
def test_bucket_is_the_number_of_bounds_below(spark, n, monkeypatch):
    monkeypatch.setattr(o, "FAN", 3)
    values = [None, *range(0, 3 * n, 3)]
    ranges = o.Ranges(("t", "s"), [[None if v is None else str(v), "m"] for v in values])
    rows = [(t, s) for t in (None, -1, 0, 1, 3, 50, 3 * n) for s in (None, "a", "m", "z")]
    df = spark.createDataFrame(rows, "t int, s string")
    low = lambda x: (x is not None, x if x is not None else 0)
    key = lambda t, s: (low(t), (s is not None, s or ""))
    for r in df.select("t", "s", ranges.bucket(df).alias("b")).collect():
        assert r["b"] == sum(key(v, "m") <= key(r["t"], r["s"]) for v in values), r


def test_ranges_of_every_kind_of_key(spark):
    df = spark.range(64).selectExpr(
        "id", "date_add(date'2020-01-01', cast(id as int)) d", "timestamp_seconds(id * 1800) t", "cast(id as decimal(20, 3)) m",
        "if(id = 3, double('NaN'), id / 7) f", "concat('k', id) s", "id % 2 = 0 as b", "cast(concat('k', id) as binary) x", "timestamp_ntz'2020-01-01 00:00:00' z",
    )
    for column in df.columns[1:]:
        ranges = o.cut_ranges(df, [column, "id"], buckets=8)
        again = o.Ranges.from_dict(ranges.to_dict())
        assert again == ranges and len(ranges.cuts) == 7
        order = [r["b"] for r in df.withColumn("b", again.bucket(df)).orderBy(column, "id").collect()]
        assert order == sorted(order) and len(set(order)) == 8, column


def test_bounds_of_another_table_change_nothing(spark, monkeypatch):
    _small_buckets(monkeypatch)
    early = spark.range(100).withColumnRenamed("id", "t")
    ranges = o.cut_ranges(early, ["t"])
    late = spark.range(1_000, 1_100).withColumnRenamed("id", "t")
    got = o.index_rows(late, ["t"], ranges=ranges, count="n").orderBy("t").collect()
    assert [(r["idx"], r["n"]) for r in got] == [(i, 100) for i in range(100)]


def test_equal_bounds_fall_together(spark):
    df = spark.range(500).selectExpr("1 as t")
    assert len(o.cut_ranges(df, ["t"], buckets=8).cuts) == 1


def test_running_weights(spark):
    pdf = _table()
    counts = pdf.groupby(["k", "t"]).size().reset_index(name="c")
    df = spark.createDataFrame(counts)
    got = o.running_weights(df, [F.col("t")], {"c": "upto"}, ["k"]).toPandas().sort_values(["k", "t"])
    assert got["upto"].tolist() == counts.sort_values(["k", "t"]).groupby("k")["c"].cumsum().tolist()
    got = o.running_weights(df, [F.col("t"), F.col("k")], {"c": "upto"}).toPandas().sort_values(["t", "k"])
    assert got["upto"].tolist() == counts.sort_values(["t", "k"])["c"].cumsum().tolist()


@pytest.mark.parametrize("fan", [2, 5])
def test_buckets_are_never_null_and_count_the_bounds(spark, monkeypatch, fan):
    """A bucket that may be null made joins search every row a second time, hash and all."""
    monkeypatch.setattr(o, "FAN", fan)
    rows = [(a, b) for a in (None, "a", "b", "c") for b in (None, 1, 2, 3)]
    df = spark.createDataFrame(rows, "a string, b bigint")
    ranges = o.Ranges(("a", "b"), [[None, "2"], ["a", None], ["a", "3"], ["b", "1"], ["b", "2"], ["c", "2"], ["d", "1"]])
    found = df.select("a", "b", ranges.bucket(df))
    assert not found.schema[o.BUCKET].nullable
    low = lambda a, b: ((a is not None, a or ""), (b is not None, b or 0))
    cuts = [low(a, b and int(b)) for a, b in ranges.cuts]
    assert {(r.a, r.b): r[o.BUCKET] for r in found.collect()} == {(a, b): sum(c <= low(a, b) for c in cuts) for a, b in rows}
