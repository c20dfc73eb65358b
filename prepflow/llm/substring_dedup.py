"""Repeated word sequences, by fixed-block anchors.

Each document's words are cut into non-overlapping blocks of (W + 1) / 2 words, W being the
window (35 words: blocks of 18): the index. Any repeated window holds a whole block of either
copy, so probing the index with every rolling window of block length finds an anchor in it.
A hit is extended to both sides as far as a whole window can reach around it, and the windows
found that way are counted by a 128-bit hash of their words. Overlapping repeated windows make up
the maximal repeats; their words go.

Nothing is paired: blocks, probes and windows travel as packed lists from buckets of documents
to owners of key ranges and back (``exchange``), so a passage shared by a third of all documents
is one entry per bucket.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prepflow.llm.arrow import numbers, packed, raw, texts
from prepflow.llm.exchange import Layout, covered, held, owner_cuts, units, window_starts
from prepflow.llm.hashing import Hasher

WINDOW = 35
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

ASK = "owner bigint, bucket bigint, probes binary, blocks binary, repeated binary"
ANSWER = "bucket bigint, owner bigint, probes binary, blocks binary"
WINDOWS = "owner bigint, bucket bigint, key binary, check binary, many binary"
REPEATED = "bucket bigint, key binary"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """32 key bits after the owner's: enough to find anchors, wrong ones only cost a candidate."""
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class _Words:
    """A bucket's words, and the hashes of its rolling windows of block length."""

    def __init__(self, table: pa.Table, window: int):
        self.block = (window + 1) // 2
        self.data, self.starts, self.ends, self.offsets = units(table, SPACE)
        self.whole = window_starts(self.offsets, window)  # where a window may start
        self.hashers = Hasher(0), Hasher(1)
        self.words = self.hashers[0].runs(self.data, self.starts, self.ends)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and alignment of the rolling windows, in texts that hold a window."""
        n = np.diff(self.offsets)
        at = np.flatnonzero(window_starts(self.offsets, self.block) & np.repeat(n >= 2 * self.block - 1, n))
        aligned = (at - np.repeat(self.offsets[:-1], n)[at]) % self.block == 0
        return at, self.hashers[0].windows(self.words, self.block)[at], aligned


def _ask(window: int, bits: int):
    """A bucket's probes and blocks, for each owner: distinct, with a flag where a block repeats here."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys, aligned = _Words(table, window).anchors()
        keys = (keys >> np.uint64(32 - bits)) << np.uint64(32 - bits)
        probes = np.unique(keys[~aligned])
        blocks, times = np.unique(keys[aligned], return_counts=True)
        owners = np.unique(np.concatenate([probes, blocks]) >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.append(owners, 1 << bits).astype(np.uint64)

        def cut(sorted_keys):
            return np.searchsorted(sorted_keys >> np.uint64(64 - bits), edges)

        return pa.Table.from_arrays(
            [
                pa.array(owners),
                pa.array(np.full(len(owners), key[0].as_py())),
                packed(_short(probes, bits), cut(probes)),
                packed(_short(blocks, bits), cut(blocks)),
                packed((times > 1).astype(np.uint8), cut(blocks)),
            ],
            names=["owner", "bucket", "probes", "blocks", "repeated"],
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Which probes hit a block, and which blocks are hit by another one."""
    blocks, block_cuts = numbers(table["blocks"], np.uint32)
    probes, probe_cuts = numbers(table["probes"], np.uint32)
    index, place = np.unique(blocks, return_inverse=True)
    many = np.bincount(place, weights=1.0 + numbers(table["repeated"], np.uint8)[0], minlength=len(index)) > 1
    hit, again = held(probes, index), many[place] if len(index) else np.zeros(0, bool)

    def only(values, flags, cuts):
        return packed(values[flags], np.concatenate([[0], np.cumsum(flags)])[cuts])

    return pa.Table.from_arrays(
        [table["bucket"], table["owner"], only(probes, hit, probe_cuts), only(blocks, again, block_cuts)],
        names=["bucket", "owner", "probes", "blocks"],
    )


def _extend(window: int, bits: int):
    """The windows around a bucket's anchors, distinct, for each owner."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        words = _Words(table, window)
        at, keys, aligned = words.anchors()
        owner = keys >> np.uint64(64 - bits)
        full = (owner << np.uint64(32)) | _short(keys, bits)

        def told(name):
            values, cuts = numbers(answers[name], np.uint32)
            owners = np.repeat(answers["owner"].to_numpy().astype(np.uint64), np.diff(cuts))
            return np.sort((owners << np.uint64(32)) | values)

        hit = np.where(aligned, held(full, told("blocks")), held(full, told("probes")))
        reach = np.zeros(len(words.whole) + window + 1, bool)
        reach[at[hit]] = True
        before = np.concatenate([[0], np.cumsum(reach)])
        n = len(words.whole)
        inside = window - words.block + 1  # a window has so many places for an anchor
        near = words.whole & (before[np.arange(n) + inside] > before[np.arange(n)])
        first, second = _window_keys(words, window, near)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(first))) > 1
        first, second = first[begin], second[begin]
        owners, cuts = owner_cuts(first, bits)
        return pa.Table.from_arrays(
            [
                pa.array(owners),
                pa.array(np.full(len(owners), key[0].as_py())),
                packed(first, cuts),
                packed((second >> np.uint64(32)).astype(np.uint32), cuts),
                packed(many.astype(np.uint8), cuts),
            ],
            names=["owner", "bucket", "key", "check", "many"],
        )

    return run


def _window_keys(words: _Words, window: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each flagged window, from two independent hashes of its words."""
    at = np.flatnonzero(where)
    first = words.hashers[0].windows(words.words, window)[at]
    second = words.hashers[1].windows(
        words.hashers[1].runs(words.data, words.starts, words.ends), window
    )[at]
    return first, second


def _count(table: pa.Table) -> pa.Table:
    """The windows that occur twice, in different buckets or within one."""
    keys, cuts = numbers(table["key"], np.uint64)
    checks = numbers(table["check"], np.uint32)[0]
    many = numbers(table["many"], np.uint8)[0]
    order = np.lexsort((checks, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1.0 + many[order])
    repeated = np.zeros(len(keys), bool)
    repeated[order] = (total > 1)[group] if len(keys) else False
    ends = np.concatenate([[0], np.cumsum(repeated)])[cuts]
    return pa.Table.from_arrays([table["bucket"], packed(keys[repeated], ends)], names=["bucket", "key"])


def _remove(window: int):
    """Take the words of repeated windows out of a bucket's texts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        words = _Words(table, window)
        repeated = np.sort(numbers(answers["key"], np.uint64)[0])
        keys = words.hashers[0].windows(words.words, window)
        again = words.whole.copy()
        again[: len(keys)] &= held(keys, repeated)
        keep = ~covered(again, window)
        data, offsets = raw(table["text"])
        data = data.tobytes()
        kept = []
        flags = keep.tolist()
        at = words.offsets.tolist()
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            kept.append(b" ".join(compress(data[s:e].split(), flags[at[i] : at[i + 1]])))
        n = np.diff(words.offsets)
        gone = np.diff(np.concatenate([[0], np.cumsum(~keep)])[words.offsets])
        return pa.Table.from_arrays(
            [
                table["doc_id"],
                pa.array(n),
                pa.array(gone),
                pa.array(kept, pa.binary()).view(pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )

    return run


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Take out every word that a repeated window of ``window`` words covers.

    Returns doc_id, n_words, n_removed, kept (the words left, joined by one space) and its
    SHA-256 for every row. Words are what ASCII white space separates, unchanged. A window is
    repeated if its words also start anywhere else, in the same document too; all copies go.
    Windows are judged on the input. A null text has no words; a text shorter than a window
    keeps all. Rows that repeat, with or without their id, are documents of their own. Null ids
    stay null, other columns are ignored, an empty table gives an empty result.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be an odd number of at least 3 words")
    docs = texts(df, id_col, text_col)
    layout = Layout(docs)
    docs = docs.select("*", layout.bucket())
    anchors = docs.groupBy("bucket").applyInArrow(_ask(window, layout.bits), ASK)
    answers = anchors.groupBy("owner").applyInArrow(_answer, ANSWER)
    candidates = (
        docs.groupBy("bucket")
        .cogroup(answers.groupBy("bucket"))
        .applyInArrow(_extend(window, layout.bits), WINDOWS)
    )
    repeated = candidates.groupBy("owner").applyInArrow(_count, REPEATED)
    return (
        docs.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_remove(window), KEPT)
    )
