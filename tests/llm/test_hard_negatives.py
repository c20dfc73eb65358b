import math

import numpy as np
import pytest

from prepflow.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, shelf int, slot int, page int, score int, window int, bar int"


def _brute(rows, every, positives, negatives, low=30, high=90, factor=256):
    kept = [
        (i, label, [math.floor(factor * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    d = max((len(v) for _, _, v in kept), default=0)
    kept = [(i, label, v + [0] * (d - len(v))) for i, label, v in kept]
    out = []
    for at, (i, label, a) in enumerate(kept):
        if i % every:
            continue
        clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        scored = [(clip(sum(x * y for x, y in zip(a, v))), j, other) for n, (j, other, v) in enumerate(kept) if n != at]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(fits)]
    return sorted(out)


def _run(spark, rows, every=4, positives=3, negatives=4, **more):
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine(df, every=every, positives=positives, negatives=negatives, **more)
    return sorted(tuple(r)[:6] for r in found.collect())


def _rows(n, seed, d=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    return [(i, [float(x) for x in centres[i % labels] + 0.6 * rng.normal(size=d)], int((i + i // 7) % labels)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"PAGE_SHELVES": 1, "PAGE_ANCHORS": 7, "SHELF": 3}])
def test_against_brute_force(spark, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _rows(300, 3)
    rows += [(400 + i, [0.5] * 6, i % 3) for i in range(30)]  # ties
    assert _run(spark, rows, block_rows=16) == _brute(rows, 4, 3, 4)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (4, [1.0], 1), (5, [], 2), (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1), (None, [9.0, 9.0], 1), (11, [1.0, 1.0], None), (12, [-3.0, 0.5], 2), (12, [2.0, 0.5], 2),
        (12, [2.0, 0.5], 2), (16, [0.0, 0.0], 1), (-4, [0.1, 0.1], 3), (20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (21, [0.5, 1.0], 2),
    ]
    assert _run(spark, rows, block_rows=2) == _brute(rows, 4, 3, 4)


def test_nothing_to_mine(spark):
    assert _run(spark, []) == []
    assert _run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert _run(spark, [(4, [1.0], 1), (5, [1.0], 2)]) == []  # no positive
    assert _run(spark, [(4, [], 1), (5, [], 1), (6, [], 2)]) == [(4, 5, 1, 6, 0, 0)]  # no dimension: all scores zero


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**40 + i, 1.0], i % 2) for i in range(12)]
    assert _run(spark, rows) == _brute(rows, 4, 3, 4)


def test_hilbert_neighbours():
    for d, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
        places = hard_negatives.hilbert(cells, bits)
        assert len(set(places)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: places[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_intervals_hold():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (40, 5))
    anchors = rng.integers(-50, 50, (7, 5))
    least, most = hard_negatives.intervals(anchors, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = anchors @ points.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


def test_blocks_apart_are_not_read(spark):
    """Labels far apart: an anchor needs only its own label's blocks, and of the others those in the window."""
    rows = [(i, [float(10 * (i % 4)), 1.0], i % 4) for i in range(256)]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1) for r in rows], SCHEMA)
    data = df.select("vec_id", df.label.cast("bigint").alias("label"), hard_negatives.whole(df.embedding, 256).alias("vector"))
    from prepflow.session import scratch_path

    path = scratch_path(spark, "test-blocks")
    d = hard_negatives.write_blocks(data, path, 16)
    anchors = spark.read.parquet(path).mapInArrow(hard_negatives._anchors(d, 64, 3), hard_negatives.ANCHORS)
    chosen = hard_negatives.Shelves(spark, path, d, 4).choose(anchors, True).collect()
    wanted = sum(bin(r["wanted"] & (2**64 - 1)).count("1") for r in chosen)
    assert 0 < wanted <= 4 * (64 // 16 + 4) < 4 * 256 // 16
