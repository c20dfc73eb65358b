import numpy as np
import pytest
from conftest import EDGES

import brute
from prepflow.llm import simhash
from prepflow.llm.components import components


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C", "a b c d", "x " * 50, "É é Ü ü a b", "tab\tand\x0bmore\nlines here"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def _near(rng, n, centres, most):
    """Values near a few centres, and values anywhere."""
    values = set(rng.integers(0, 2**64, n, dtype=np.uint64).tolist())
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64).tolist():
        for _ in range(n // 2):
            for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
                c2 = c ^ (1 << int(b))
                values.add(c2)
    return sorted(values)


@pytest.mark.parametrize("node_rows,centres,most", [(1 << 10, 3, 4), (6, 3, 6), (2, 1, 5)])
def test_links_whatever_the_node_size(spark, node_rows, centres, most):
    values = _near(np.random.default_rng(centres), 120, centres, most)
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint").repartition(3)
    forest = simhash.links(prints, node_rows=node_rows).collect()
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in forest:
        a, b = (int(np.int64(x).view(np.uint64)) for x in (r["a"], r["b"]))
        assert (a ^ b).bit_count() <= 64
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = brute.linked(values)
    assert {v: find(v) for v in values} == want


def test_walk_is_the_join_of_all_pairs():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**12, 300, dtype=np.uint64) << np.uint64(52))
    forest = simhash.Forest(len(keys))
    n = np.array([len(keys)])
    simhash.walk(keys, (n * 0, n, n * 0, n), 0, 3, forest)
    want = brute.linked(keys.tolist())
    got = {int(k): int(keys[forest.root[i]]) for i, k in enumerate(keys)}
    assert got == want


def test_against_brute_force(clash, prose):
    base = prose(40, 5, "alpha beta gamma delta eps zeta eta theta iota")
    near = [(100 + i, t + " tail") for i, t in base] + [(200 + i, t.upper()) for i, t in base[:10]]
    rows = base + near + EDGES
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(clash([(i, t) for i, t in dict(rows).items()])).collect()}
    assert found == brute.classes(list(dict(rows).items()))


def test_repeated_and_null_ids(clash):
    rows = [(3, "a b c d"), (3, "a b c d"), (3, "else where now"), (None, "a b c d"), (None, "zz yy xx")]
    found = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(clash(rows)).collect())
    a, b, c = (f"{brute.simhash(t):016x}" for t in ("a b c d", "else where now", "zz yy xx"))
    assert found == sorted([("3", a, 3), ("3", a, 3), ("3", b, 3), ("None", a, 3), ("None", c, None)])


def test_no_rows(clash):
    assert simhash.near_duplicates(clash([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1_000, 1_000 + i) for i in range(1, 60)]
    rows = [*path, *star, (5, 5), (7_000, 7_000), (None, 3), (2, None)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(4)
    got = {r["node"]: r["root"] for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1_000 + i: 1_000 for i in range(60)}, 7_000: 7_000}
