import math
from collections import Counter, defaultdict

import pytest
from conftest import EDGES
from pyspark.sql import functions as F

from prepflow.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, n int, h int, block int, cut int, whole int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def _rows():
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(300)]
    rows += [(1_000 + i, "w " * (3 + i % 5), "mid") for i in range(90)]
    rows += [(2_000 + i, "w w", "tiny") for i in range(25)] + [(3_000 + i, "v " * 9, None) for i in range(40)]
    return rows + [(4_000, None, "empty"), (4_001, " \n", "empty")]


def _exponent(totals, limit):
    """The smallest exponent at which no source is repeated more often, by plain bisection."""
    low, high = 0.0, 1.0
    ratio = min(totals) / max(totals)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if ratio ** (middle - 1) <= limit else (middle, high)
    return high


def _places(df):
    identity = F.xxhash64("doc_id", "text")
    return {
        (r["doc_id"], r["text"]): r["h"]
        for r in df.select("doc_id", "text", mixing.order_hash(identity, F.lit(mixing.PARTIAL), 17).alias("h")).collect()
    }


def _brute(df, repetition):
    """Copies of each row: whole passes, and those that come first in the order of the partial pass."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    place, tokens = _places(df), lambda t: len((t or "").encode().split())
    totals = Counter()
    for _, t, s in rows:
        totals[s] += tokens(t)
    copies = {}
    for source, total in totals.items():
        mine = sorted((r for r in rows if r[2] == source), key=lambda r: place[r[0], r[1]])
        if not total:
            copies |= {r[0]: 1 for r in mine}
            continue
        wanted = math.floor(total * repetition(total, max(totals.values())) + 0.5)
        whole, left = divmod(wanted, total)
        for r in mine:
            left -= tokens(r[1])
            copies[r[0]] = whole + (left >= 0)
            if left < 0:
                left = -math.inf
    return copies


@pytest.mark.parametrize("limit", [1.5, 3.0, 100.0])
def test_against_brute_force(spark, limit):
    df = _table(spark, _rows())
    totals = Counter()
    for _, t, s in _rows():
        totals[s] += len((t or "").split())
    a = _exponent([v for v in totals.values() if v], limit)
    got = Counter(r["doc_id"] for r in mixing.mix(df, max_repetition=limit).collect())
    want = _brute(df, lambda n, largest: (n / largest) ** (a - 1))
    assert sum(got[i] != c for i, c in want.items()) <= 2  # the exponent is found to 1e-8
    assert set(got) == set(want) and all(got[r[0]] == 1 for r in _rows() if r[2] == "big")


def test_budget_and_entropy(spark):
    df = _table(spark, _rows())
    mixed = mixing.mix(df, target_entropy=1.2, budget=900)
    spent = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("t")).collect()}
    spent.pop("empty", None)
    total = sum(spent.values())
    assert 860 <= total <= 900
    assert -sum(v / total * math.log(v / total) for v in spent.values()) == pytest.approx(1.2, abs=0.03)


def test_passes_are_permutations_of_blocks(spark):
    df = _table(spark, _rows())
    found = mixing.mix(df, max_repetition=100.0).where("source = 'tiny'").collect()
    by = defaultdict(dict)
    for r in found:
        by[r["copy"]][r["doc_id"]] = r["block"]
    whole = [c for c in by.values() if len(c) == 25]
    assert len(whole) >= 2 and whole[0] != whole[1]
    again = mixing.mix(df, max_repetition=100.0).where("source = 'tiny'").collect()
    assert sorted(found) == sorted(again)


def test_edges(spark):
    rows = [(i, t, "a") for i, t in EDGES] + [(4, "One Two three", "a"), (4, "One Two three", "a"), (70, "x y", None), (71, "z", None)]
    found = mixing.mix(_table(spark, rows))
    got = Counter((r["doc_id"], r["text"] is None) for r in found.select("doc_id", "text").collect())
    assert set(got) == {(i, t is None) for i, t, _ in rows}
    assert found.columns == ["doc_id", "text", "source", "n", "h", "cut", "whole", "copy", "block"]
    assert mixing.mix(_table(spark, [])).count() == 0
    assert mixing.mix(_table(spark, [(1, None, None), (2, "", "s")])).count() == 2


def test_one_source_is_read_once(spark):
    rows = [(i, "a b c", "only") for i in range(20)]
    assert Counter(r["copy"] for r in mixing.mix(_table(spark, rows)).collect()) == {0: 20}
