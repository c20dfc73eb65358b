import random

import pytest
from conftest import EDGES

import brute
from prepflow.llm import exchange, line_dedup, substring_dedup
from prepflow.llm.hashing import Hasher

import numpy as np


def test_hashes_tell_runs_apart():
    data = np.frombuffer(b"ab abc ab  x", np.uint8)
    starts, ends = np.array([0, 3, 7, 11]), np.array([2, 6, 9, 12])
    a = Hasher(0).runs(data, starts, ends)
    assert a[0] == a[2] and len(set(a.tolist())) == 3
    assert Hasher(1).runs(data, starts, ends)[0] != a[0]
    w = Hasher(0).windows(np.array([1, 2, 3, 1, 2, 3, 1], np.uint64), 3)
    assert w[0] == w[3] and w[1] == w[4] and len(set(w.tolist())) == 3
    assert len(Hasher(0).windows(a, 9)) == 0


def test_hashes_do_not_depend_on_the_span(monkeypatch):
    from prepflow.llm import hashing

    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5_000).astype(np.uint8)
    starts = np.arange(0, 4_900, 7)
    want = Hasher(0).runs(data, starts, starts + 5), Hasher(0).windows(starts.astype(np.uint64), 4)
    monkeypatch.setattr(hashing, "SPAN", 64)
    assert (Hasher(0).runs(data, starts, starts + 5) == want[0]).all()
    assert (Hasher(0).windows(starts.astype(np.uint64), 4) == want[1]).all()


@pytest.mark.parametrize("window,seed", [(5, 1), (9, 2), (35, 3)])
def test_windows_against_brute_force(clash, prose, window, seed, monkeypatch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 2_000)
    rows = prose(120, seed) + [(i, t) for i, t in prose(12, seed + 9)] + EDGES
    rng = random.Random(seed)
    long = " ".join(rng.choices("p q r s t u v w x y".split(), k=60))
    rows += [(500 + i, f"{'m ' * i}{long} end{i}") for i in range(6)]
    found = substring_dedup.remove_repeats(clash(rows), window=window).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in found)
    assert got == sorted((str(a), b, c, d) for a, b, c, d in brute.without_windows(rows, window))
    assert all(r["kept_sha256"] == brute.sha(r["kept"].encode()) for r in found)


def test_windows_of_one_document(clash):
    rows = [(1, "a b c x a b c y"), (2, "c x a")]
    found = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(clash(rows), window=3).collect()}
    assert found == {1: "b y", 2: ""} or found == {i: k for i, _, _, k in brute.without_windows(rows, 3)}


def test_windows_no_rows(clash):
    assert substring_dedup.remove_repeats(clash([])).count() == 0
    with pytest.raises(ValueError, match="odd"):
        substring_dedup.remove_repeats(clash([]), window=4)


@pytest.mark.parametrize("gram,window,seed", [(2, 2, 1), (1, 1, 2), (1, 3, 3), (3, 2, 4)])
def test_lines_against_brute_force(clash, gram, window, seed, monkeypatch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 500)
    rng = random.Random(seed)
    lines = ["alpha", " beta ", "gamma\r", "", "  ", "delta delta", "é"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(90)] + [(None, "alpha\n beta\ngamma\ndelta delta")]
    rows += [(100 + i, t) for i, t in EDGES if i is not None]
    found = line_dedup.remove_repeated_lines(clash(rows), gram=gram, window=window).collect()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in found}
    assert got == brute.without_lines(rows, gram + window - 1)
    assert all(r["kept_sha256"] == brute.sha(r["kept"].encode()) for r in found)


def test_lines_carry_and_repeated_ids(clash):
    text = "a\nb\nc"
    rows = [(1, text), (1, text), (1, text + "\nd"), (None, text), (None, text)]
    found = line_dedup.remove_repeated_lines(clash(rows), carry=("sha", "key")).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 3, 3, 3, 3] and {r["sha"] for r in found} == {7}
    assert all(r["n_removed"] == 3 for r in found if r["doc_id"] is None)
    assert line_dedup.remove_repeated_lines(clash([]), carry=("sha",)).count() == 0
