import hashlib

import numpy as np
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from prepflow.llm import exact_dedup, golomb


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sampled_from([1, 7, 2**40]))
def test_golomb_round_trip(values, step):
    values = np.array(sorted({v // step for v in values}), np.uint64)
    assert (golomb.decode(golomb.encode(values)) == values).all()


def test_golomb_is_short():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**50, 50_000, dtype=np.uint64))
    assert len(golomb.encode(values)) * 8 / len(values) < 50 - np.log2(len(values)) + 3


def _check(found, rows):
    want, groups = brute.exact(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r["keep_id"], r["group_size"]) == want[r["doc_id"], r["text_sha256"]]
    stays = [(r["text_sha256"], r["doc_id"]) for r in found if r["kept"]]
    assert len(stays) == len(groups) and {s for s, _ in stays} == set(groups)
    assert all(i == max((j for j in groups[s] if j is not None), default=None) for s, i in stays)


def test_against_brute_force(clash, prose, monkeypatch):
    rows = prose(80, 1) + [(200 + i, t) for i, t in prose(80, 1)[:30]] + [(i, "same TEXT") for i in range(300, 330)]
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 13)
    _check(exact_dedup.exact_duplicates(clash(rows)).collect(), rows)


def test_edges(clash):
    rows = EDGES + [(4, "one two three"), (4, "one two three"), (None, "n"), (None, "N"), (9, "other")]
    _check(exact_dedup.exact_duplicates(clash(rows)).collect(), rows)


def test_no_rows(clash):
    assert exact_dedup.exact_duplicates(clash([])).count() == 0


def test_equal_fingerprints_of_different_texts(clash, monkeypatch):
    """The exchange only names suspects; bytes decide."""
    monkeypatch.setattr(exact_dedup, "_fingerprints", lambda shas: np.full(len(shas), 2**63 + 5, np.uint64))
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    _check(exact_dedup.exact_duplicates(clash(rows)).collect(), rows)
    assert hashlib.sha256(b"a").hexdigest() in {r["text_sha256"] for r in exact_dedup.exact_duplicates(clash(rows)).collect()}
