"""Copies are dropped in place: rows without one are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from prepflow.operators import duplicates as d


def _rows(n, copies, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b" * 30]), rng.choice([0.0, -0.0, None, 1.5]), [i % 3]) for i in range(n)]
    return rows + [rng.choice(rows) for _ in range(copies)]


SCHEMA = "k bigint, s string, f double, l array<int>"


def _same(found, rows):
    normal = lambda r: (r[0], r[1], None if r[2] is None else r[2] + 0.0, tuple(r[3]))
    assert sorted(map(repr, map(normal, found))) == sorted(map(repr, {normal(r) for r in rows}))


@pytest.mark.parametrize("copies", [0, 1, 40, 600])
def test_one_of_each(spark, copies):
    rows = _rows(200, copies)
    _same(d.drop_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), rows)


def test_few_rows_move(spark):
    """Rows with a copy are flagged, all of them, and no others but for chance collisions of 26 bits."""
    rows = _rows(3_000, 25)
    marked = d.mark_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    keys = [r["k"] for r in marked]
    assert {r["k"] for r in marked if r["__suspect"]} == {k for k in keys if keys.count(k) > 1}


def test_marks_are_bounded_and_full_ones_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(d, "SLOT_BITS", 16)  # two rows of the mark table
    rows = _rows(2_000, 2_000)
    df = spark.createDataFrame(rows, SCHEMA)
    assert d._marks(df.select(d.row_key(df).alias("h"))).count() <= 2
    _same(d.drop_copies(df).collect(), rows)
    monkeypatch.setattr(d, "row_key", lambda df: F.lit(-1).cast("bigint"))  # every hash collides
    _same(d.drop_copies(df).collect(), rows)


def test_rows_without_a_copy_are_not_shuffled(spark):
    """All columns meet an exchange only below the aggregate of the flagged rows."""
    df = spark.createDataFrame(_rows(50, 5), SCHEMA)
    plan = d.drop_copies(df)._jdf.queryExecution().executedPlan().toString()
    plain, compared = plan.split("Union", 1)[1].split("HashAggregate(keys=[k", 1) if "HashAggregate(keys=[k" in plan else plan.split("Union", 1)[1].split("SortAggregate(key=[k", 1)
    shuffles = [line for line in plain.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("hashpartitioning(k" in line for line in shuffles)
    assert "hashpartitioning(k" in compared


def test_narrow_rows_are_compared_at_once(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 2), (None, 2)], "a bigint, b bigint")
    assert sorted(d.drop_copies(df).collect(), key=str) == [(1, 2), (None, 2)]
    assert "Union" not in d.drop_copies(df)._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    assert d.drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0
