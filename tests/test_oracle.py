"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import pytest

import __spark_entry__ as entry
import oracle
from prepflow.queries import ORACLE as SQL
from prepflow.queries import QUERIES

# Trained at full size elsewhere: the unit tests cover them with small settings.
SLOW = {"train_random_forest", "train_extra_trees", "train_gbt"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, key):
    assert oracle.compare(QUERIES[key](spark, sf_dir), duck, SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and "skewness" in df.columns


def test_keys():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert SQL.items() <= entry.oracle_sql().items()
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]
