"""Repeated runs of lines, by winnowing.

Every ``gram`` consecutive lines are hashed, and of every ``window`` consecutive hashes the
smallest is selected as a fingerprint (the rightmost of equals). Any run of
``window + gram - 1`` lines that two places share therefore shares a fingerprint: that is the
shortest run looked for. Fingerprints, about two in ``window + 1`` lines, are joined by an exchange
between buckets of documents and owners of key ranges; positions whose fingerprint occurs
elsewhere are extended both ways to the shortest runs around them, and these are joined by a
second exchange, which also settles where each run occurs first. Later copies go; overlapping
shortest runs make up the longest ones.

Fewer lines may be a passage too: each run of fewer lines that has ``passage`` words or more is
joined as a whole by the same two exchanges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.arrow import numbers, packed, raw, texts
from prepflow.llm.exchange import Layout, covered, held, owner_cuts, units, window_starts
from prepflow.llm.hashing import Hasher, mix
from prepflow.llm.substring_dedup import SPACE

GRAM = 2
WINDOW = 2
PASSAGE = 50  # words
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
NO_ID = np.iinfo(np.int64).max  # null ids come last

ASK = "owner bigint, bucket bigint, key binary, many binary"
ANSWER = "bucket bigint, key binary"
RUNS = "owner bigint, bucket bigint, key binary, check binary, many binary, id binary, row binary"
LATER = "bucket bigint, key binary, first binary"
KEPT = "doc_id bigint, n_lines bigint, n_removed bigint, kept string, kept_sha256 string"


class _Lines:
    """A bucket's texts in the order that decides what comes first, their lines and line hashes."""

    def __init__(self, table: pa.Table, gram: int, window: int, passage: int):
        self.ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        text = table["text"]
        order = pc.sort_indices(
            pa.table({"id": self.ids, "text": text}), [("id", "ascending"), ("text", "ascending")]
        )
        self.table = table.take(order)
        self.ids = self.ids[order.to_numpy()]
        self.shortest = gram + window - 1
        self.data, self.starts, self.ends, self.offsets = units(self.table, NEWLINE, SPACE)
        self.hashers = Hasher(0), Hasher(1)
        self.lines = self.hashers[0].runs(self.data, self.starts, self.ends)
        self.gram, self.window, self.passage = gram, window, passage

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the selected hashes are, and which they are."""
        grams = self.hashers[0].windows(self.lines, self.gram)
        ok = window_starts(self.offsets, self.shortest)[: max(0, len(grams) - self.window + 1)]
        begin = np.flatnonzero(ok)
        if not len(begin):
            return begin, np.zeros(0, np.uint64)
        best = begin + self.window - 1
        for back in range(self.window - 2, -1, -1):
            best = np.where(grams[begin + back] < grams[best], begin + back, best)
        at = np.unique(best)
        return at, grams[at]

    def passages(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of fewer than ``shortest`` lines, but of enough words: how many lines, positions, hashes."""
        word = ~SPACE[self.data]
        word[1:] &= SPACE[self.data[:-1]]
        word[self.starts] = True
        before = np.concatenate([[0], np.cumsum(word)])
        words = np.concatenate([[0], np.cumsum(before[self.ends] - before[self.starts])])
        out = []
        for size in range(1, self.shortest):
            at = np.flatnonzero(window_starts(self.offsets, size))
            at = at[words[at + size] - words[at] >= self.passage]
            out.append((size, at, self.sized(self.hashers[0].windows(self.lines, size)[at], size)))
        return out

    @staticmethod
    def sized(hashes: np.ndarray, size: int) -> np.ndarray:
        """Hashes that tell runs of ``size`` lines from runs of other lengths."""
        return mix(hashes ^ np.uint64(size))

    def runs(self, where: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and two hashes of the shortest runs at the flagged lines, and of the passages asked for."""
        at = np.flatnonzero(where)
        lines = self.hashers[1].runs(self.data, self.starts, self.ends)
        found = [
            (
                at,
                self.hashers[0].windows(self.lines, self.shortest)[at],
                self.hashers[1].windows(lines, self.shortest)[at],
            )
        ]
        for size, at, keys in self.passages():
            take = held(keys, asked)
            at, keys = at[take], keys[take]
            found.append((at, keys, self.sized(self.hashers[1].windows(lines, size)[at], size)))
        return tuple(np.concatenate(x) for x in zip(*found))


def _ask(gram: int, window: int, passage: int, bits: int):
    """A bucket's fingerprints and passages, for each owner: distinct, with a flag where one repeats here."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lines = _Lines(table, gram, window, passage)
        keys = np.concatenate([lines.fingerprints()[1], *[k for _, _, k in lines.passages()]])
        keys, times = np.unique(keys, return_counts=True)
        owners, cuts = owner_cuts(keys, bits)
        return pa.Table.from_arrays(
            [
                pa.array(owners),
                pa.array(np.full(len(owners), key[0].as_py())),
                packed(keys, cuts),
                packed((times > 1).astype(np.uint8), cuts),
            ],
            names=["owner", "bucket", "key", "many"],
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The fingerprints and passages that occur twice."""
    keys, cuts = numbers(table["key"], np.uint64)
    _, place = np.unique(keys, return_inverse=True)
    again = (np.bincount(place, weights=1.0 + numbers(table["many"], np.uint8)[0]) > 1)[place]
    ends = np.concatenate([[0], np.cumsum(again)])[cuts]
    return pa.Table.from_arrays([table["bucket"], packed(keys[again], ends)], names=["bucket", "key"])


def _extend(gram: int, window: int, passage: int, bits: int):
    """The shortest runs around joined positions, and joined passages: each once, with its first place in this bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        lines = _Lines(table, gram, window, passage)
        at, keys = lines.fingerprints()
        asked = np.sort(numbers(answers["key"], np.uint64)[0])
        hit = at[held(keys, asked)]
        whole = window_starts(lines.offsets, lines.shortest)
        marks = np.zeros(len(whole) + window + 1, np.int64)
        marks[hit] = 1
        before = np.concatenate([[0], np.cumsum(marks)])
        n = np.arange(len(whole))
        at, first, second = lines.runs(whole & (before[n + window] > before[n]), asked)
        order = np.lexsort((at, second, first))  # texts are in order, so the first place comes first
        at, first, second = at[order], first[order], second[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(first))) > 1
        first, second, at = first[begin], second[begin], at[begin]
        row = np.searchsorted(lines.offsets, at, "right") - 1
        owners, cuts = owner_cuts(first, bits)
        return pa.Table.from_arrays(
            [
                pa.array(owners),
                pa.array(np.full(len(owners), key[0].as_py())),
                packed(first, cuts),
                packed((second >> np.uint64(32)).astype(np.uint32), cuts),
                packed(many.astype(np.uint8), cuts),
                packed(lines.ids[row], cuts),
                packed(row.astype(np.int32), cuts),
            ],
            names=["owner", "bucket", "key", "check", "many", "id", "row"],
        )

    return run


def _first(table: pa.Table) -> pa.Table:
    """The runs that occur twice, with a flag for the bucket that holds the first one."""
    keys, cuts = numbers(table["key"], np.uint64)
    checks = numbers(table["check"], np.uint32)[0]
    many = numbers(table["many"], np.uint8)[0]
    ids = numbers(table["id"], np.int64)[0]
    rows = numbers(table["row"], np.int32)[0]
    buckets = np.repeat(table["bucket"].to_numpy(), np.diff(cuts))
    order = np.lexsort((rows, buckets, ids, checks, keys))
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(checks[order]) != 0)
    group = np.cumsum(new) - 1
    again = np.zeros(len(keys), bool)
    if len(keys):
        again[order] = (np.bincount(group, weights=1.0 + many[order]) > 1)[group]
    first = np.zeros(len(keys), np.uint8)
    first[order[new]] = 1
    ends = np.concatenate([[0], np.cumsum(again)])[cuts]
    return pa.Table.from_arrays(
        [table["bucket"], packed(keys[again], ends), packed(first[again], ends)],
        names=["bucket", "key", "first"],
    )


def _remove(gram: int, window: int, passage: int):
    """Take the lines of later runs out of a bucket's texts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        lines = _Lines(table, gram, window, passage)
        keys = numbers(answers["key"], np.uint64)[0]
        first = numbers(answers["first"], np.uint8)[0]
        order = np.argsort(keys)
        keys, first = keys[order], first[order].astype(bool)
        whole = window_starts(lines.offsets, lines.shortest)
        at = np.flatnonzero(whole)
        gone = np.zeros(len(whole), bool)
        longest = (lines.shortest, at, lines.hashers[0].windows(lines.lines, lines.shortest)[at])
        for size, at, runs in [longest, *lines.passages()]:
            again = held(runs, keys)
            at, runs = at[again], runs[again]
            stays = np.zeros(len(at), bool)
            if len(at):
                _, earliest = np.unique(runs, return_index=True)  # texts are in order
                stays[earliest] = first[np.searchsorted(keys, runs)[earliest]]
            later = np.zeros(len(whole), bool)
            later[at[~stays]] = True
            gone |= covered(later, size)
        data, offsets = raw(lines.table["text"])
        data = data.tobytes()
        kept, removed = [], []
        for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            mine = slice(lines.offsets[i], lines.offsets[i + 1])
            n = int(gone[mine].sum())
            text = data[s:e]
            if n:
                drop = set((lines.starts[mine][gone[mine]] - s).tolist())
                out, here = [], 0
                for line in text.split(b"\n"):
                    if here + len(line) - len(line.lstrip(b" \t\r\x0b\x0c")) not in drop:
                        out.append(line)
                    here += len(line) + 1
                text = b"\n".join(out)
            kept.append(text)
            removed.append(n)
        carried = [c for c in lines.table.column_names if c.startswith("carry_")]
        return pa.Table.from_arrays(
            [
                lines.table["doc_id"],
                pa.array(np.diff(lines.offsets)),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).view(pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                *[lines.table[c] for c in carried],
            ],
            names=["doc_id", "n_lines", "n_removed", "kept", "kept_sha256", *carried],
        )

    return run


def remove_repeated_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    window: int = WINDOW,
    passage: int = PASSAGE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Delete every line in a later copy of a run of ``gram + window - 1`` lines or of ``passage`` words, or longer.

    Returns doc_id, n_lines, n_removed, kept (the text left) and its SHA-256 for every row, and
    the columns named in ``carry``. Lines end at a line feed and are compared without the ASCII white space
    around them; blank lines are not counted, never deleted, and do not interrupt a run. Of equal
    runs the first stays: the smallest id (null last), then the earliest line; of rows with the
    same id the order is arbitrary but the same for all runs of one input. Runs are judged on the
    input. A null text has no lines. Clashing names of other columns do no harm, and an empty
    table gives an empty result.
    """
    docs = texts(df, id_col, text_col, *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    layout = Layout(docs)
    docs = docs.select("*", layout.bucket())
    prints = docs.groupBy("bucket").applyInArrow(_ask(gram, window, passage, layout.bits), ASK)
    joined = prints.groupBy("owner").applyInArrow(_answer, ANSWER)
    runs = (
        docs.groupBy("bucket")
        .cogroup(joined.groupBy("bucket"))
        .applyInArrow(_extend(gram, window, passage, layout.bits), RUNS)
    )
    later = runs.groupBy("owner").applyInArrow(_first, LATER)
    carried = "".join(f", carry_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = docs.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(
        _remove(gram, window, passage), KEPT + carried
    )
    return out.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
