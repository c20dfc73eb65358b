import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prepflow.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, part int, r int, n int, x int, component int"


def _run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], SCHEMA).repartition(parts)
    return whitening.whiten(df, **more).collect()


def _reference(rows, k):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v) for i, v in kept if len(v) == d]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    away = n * x - s
    centred = (away / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [i for i, _ in kept], n, (away * away).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("parts, block, fold", [(1, 4096, 16), (7, 11, 2)])
def test_against_reference(spark, monkeypatch, parts, block, fold):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "FOLD", fold)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + rng.normal(size=12) * 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] + [1.0] * 11), (903, [2.0] * 5), (None, [0.5] * 12), (3, rows[3][1])]
    found = _run(spark, rows, parts)
    ids, n, deviation, whitened, explained = _reference(rows, 8)
    assert len(found) == 8 * n and {r["n"] for r in found} == {n}
    key = lambda i, dev: (i is None, i or 0, dev)
    want = {key(i, dev): w for i, dev, w in zip(ids, deviation, whitened)}
    assert {key(r["vec_id"], r["deviation"]) for r in found} == set(want)
    for c in range(8):
        mine = [r for r in found if r["component"] == c + 1]
        pairs = np.array([(r["whitened"], want[key(r["vec_id"], r["deviation"])][c]) for r in mine])
        sign = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.abs(pairs[:, 0] * sign - pairs[:, 1]).max() < 1e-9
        assert abs(mine[0]["explained"] - explained[c]) < 1e-12
    assert max(r["identity_error"] for r in found) < 1e-9


def test_edges(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, None), (2, [])]) == []
    one = _run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])  # no variance at all
    assert len(one) == 4 and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, 0.0, None, 0) for r in one)
    line = _run(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])  # one direction without variance
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert max(r["identity_error"] for r in line) < 1e-9
    far = _run(spark, [(1, [1e12]), (2, [-1e12]), (3, [1e300])])  # too large for a long, and a deviation that is
    assert {r["vec_id"] for r in far} == {1, 2} and {r["deviation"] for r in far} == {2**63 - 1}


shapes = st.integers(1, 12)


@settings(max_examples=60, deadline=None)
@given(shapes, st.integers(0, 2**32), st.sampled_from(["full", "rank", "graded", "equal", "copies", "zero"]))
def test_principal(d, seed, kind):
    rng = np.random.default_rng(seed)
    a = {
        "full": lambda: rng.normal(size=(3 * d, d)),
        "rank": lambda: rng.normal(size=(3 * d, 1)) @ rng.normal(size=(1, d)),
        "graded": lambda: rng.normal(size=(3 * d, d)) @ np.diag(10.0 ** -np.arange(d)),
        "equal": lambda: np.linalg.qr(rng.normal(size=(3 * d, d)))[0],
        "copies": lambda: np.repeat(rng.normal(size=(3 * d, 1)), d, axis=1),
        "zero": lambda: np.zeros((3 * d, d)),
    }[kind]()
    r = np.vstack([np.linalg.qr(a, mode="r"), np.zeros((d, d))])[:d]
    diagonal, above, v = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    top = max(np.linalg.norm(a, 2), 1e-300)
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.abs(r.T @ r - v @ b.T @ b @ v.T).max() <= 1e-13 * top * top
    singular = np.sqrt(whitening.squared_singular_values(diagonal, above))
    assert np.abs(singular - np.linalg.svd(a, compute_uv=False)).max() <= 1e-13 * top
    values, vectors = whitening.principal(r, 1, 8)
    assert np.abs(vectors.T @ vectors - np.eye(min(8, d))).max() < 1e-8
    assert np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-11 * top * top
