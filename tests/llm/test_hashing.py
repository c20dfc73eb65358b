"""Hashes against their definition, and texts that no polynomial modulo 2^64 tells apart."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prepflow.llm import hashing, line_dedup, substring_dedup
from prepflow.llm.hashing import PRIME, Hasher, mix, times


def _plain(text: bytes, which: int) -> int:
    base = hashing.BASES[which] % PRIME
    value = sum((b + 1) * pow(base, i, PRIME) for i, b in enumerate(text)) % PRIME
    return int(mix(np.array([value], np.uint64) ^ mix(np.array([len(text)], np.uint64)))[0])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30), st.sampled_from([0, 1]), st.sampled_from([8, 64, 1 << 16]))
def test_runs_against_definition(texts, which, piece):
    kept, hashing.PIECE = hashing.PIECE, piece
    try:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) + np.arange(len(texts))
        starts = ends - np.array([len(t) for t in texts], np.int64)
        assert Hasher(which).runs(data, starts, ends).tolist() == [_plain(t, which) for t in texts]
    finally:
        hashing.PIECE = kept


@given(st.integers(0, PRIME - 1), st.integers(0, PRIME - 1))
def test_products(a, b):
    assert int(times(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == a * b % PRIME


def _thue_morse(n: int, one: str, other: str) -> str:
    return "".join(other if bin(i).count("1") % 2 else one for i in range(n))


A, B = _thue_morse(2048, "a", "b"), _thue_morse(2048, "b", "a")


def test_words_that_collided_are_apart(spark):
    rows = [(1, " ".join([A, *"bcdefghij" * 4][:35])), (2, " ".join([B, *"bcdefghij" * 4][:35]))]
    found = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["n_words"], r["n_removed"]) for r in found} == {(35, 0)}


def test_lines_that_collided_are_apart(spark):
    rows = [(1, f"x\ny\n{A}"), (2, f"x\ny\n{B}")]
    found = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in found} == dict(rows)


def test_windows_are_bounded():
    with pytest.raises(ValueError):
        Hasher().windows(np.zeros(9, np.uint64), hashing.MOST_ITEMS + 1)
