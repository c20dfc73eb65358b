import math

import numpy as np
import pytest

from prepflow.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, shard int, block int, ask int, score int, rank int, home int"


def _brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, q), q)
    width = max((len(v) for v in best.values()), default=0)
    best = {i: v + [0] * (width - len(v)) for i, v in best.items()}
    out = []
    for q in best:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def _run(spark, rows, k=5, every=4, **sizes):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, k, every, **sizes).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "query_rows": 9}])
def test_against_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6))
    rows = [(int(i), [float(x) for x in centres[i % 4] + 0.2 * rng.normal(size=6)]) for i in range(240)]
    rows += [(300 + i, [0.25] * 6) for i in range(30)]  # ties
    assert _run(spark, rows, **sizes) == _brute(rows, 5, 4)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (4, [1.0]), (5, []), (6, None), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [9.0, 9.0]),
        (12, [-3.0, 0.5]), (12, [2.0, 0.5]), (12, [2.0, 0.5]), (16, [0.0, 0.0]), (-4, [0.1, 0.1]),
    ]
    assert _run(spark, rows) == _brute(rows, 5, 4)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**22 + i, 1.0 / 64]) for i in range(6)]
    assert _run(spark, rows, every=2) == _brute(rows, 5, 2)
    huge = _run(spark, [(0, [1e17]), (1, [1e17]), (2, [-1e17])], every=5)
    assert [r[2:] for r in huge] == [(1, 2**63 - 1), (2, -(2**63))]


def test_no_rows_and_no_queries(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert _run(spark, [(4, [1.0])]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(c, 1, (500, 8)) for c in (-50, 0, 50)]).round()
    tree = topk.Tree(np.arange(1_500), rows, leaf=32)
    query = np.full(8, 3.0)
    bounds = tree.bounds(query[None])[0]
    for node in range(len(tree.begin)):
        assert (tree.rows[tree.begin[node] : tree.end[node]] @ query).max() <= bounds[node] + 1e-9
    seen = []
    scores = tree.rows @ query
    kth = np.sort(scores)[-10]
    for node in range(len(tree.begin)):
        if tree.left[node] < 0 and bounds[node] >= kth:
            seen.append(node)
    assert len(seen) < sum(left < 0 for left in tree.left) / 2
