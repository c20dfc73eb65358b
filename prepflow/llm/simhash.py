"""SimHash near-duplicates: fingerprints of word shingles, linked by self-joins of binary tries.

A trie holds distinct fingerprints, one bit per level. The self-join walks pairs of nodes
together, adds up the bits in which their prefixes differ, and drops a pair once that exceeds
the error budget of ``DISTANCE`` bits. To deal the walk out, the trie is built in four bit
orders, each with another 16-bit block in front. Two fingerprints within three bits agree on at
least one whole block, so in one of the four tries they lie below the same node at depth 16,
and the walk may start at those nodes: every node with itself, budget still whole. A node with
more than ``NODE_ROWS`` fingerprints is dealt out by the pairs of its subtrees instead, again
only pairs within the budget, so no task holds an unbounded node.

A task reports a spanning forest of the links it finds, not the links: at most one row per
fingerprint. The forests are merged by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.arrow import raw, slices, texts
from prepflow.llm.components import components
from prepflow.session import checkpoint

DISTANCE = 3
BLOCK = 16  # 64 / (DISTANCE + 1)
NODE_ROWS = 1 << 10
BATCH_ROWS = 1 << 16
PAIR_ROWS = 1 << 20
SEED = 42
FP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of one text; see ``near_duplicates`` for its definition."""
    tokens = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), PAIR_ROWS >> 4):
        part = slice(at, at + (PAIR_ROWS >> 4))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[part], ends[part])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = raw(part.column(1))
            data = data.tobytes()
            fps = [fingerprint(data[s:e], words) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], schema=FP_SCHEMA
            )

    return run


class Forest:
    """Union-find over positions, many links at a time; the root is the smallest position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _product(a0, a1, b0, b1):
    """Every (i, j) of the ranges a and b, pair by pair."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    pair = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return a0[pair] + at // nb[pair], b0[pair] + at % nb[pair]


def walk(keys: np.ndarray, nodes: tuple, depth: int, distance: int, forest: Forest) -> None:
    """Join tries by pairs of nodes.

    ``keys`` are fingerprints sorted within each node, ``nodes`` four arrays: pairs of position
    ranges (a0, a1, b0, b1) whose keys agree within each range down to ``depth``.
    """
    zeros: dict[int, np.ndarray] = {}

    def split(level, lo, hi):
        if level not in zeros:
            bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
            zeros[level] = np.concatenate([[0], np.cumsum(bit == 0)])
        return lo + zeros[level][hi] - zeros[level][lo]

    a0, a1, b0, b1 = nodes
    above = np.uint64(((1 << depth) - 1) << (64 - depth)) if depth else np.uint64(0)
    diff = np.bitwise_count((keys[a0] ^ keys[b0]) & above).astype(np.int64)
    stack = [(depth, a0, a1, b0, b1, diff)]
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > PAIR_ROWS >> 2:
            half = len(a0) // 2
            stack.append((level, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:]))
            a0, a1, b0, b1, diff = a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():
            i, j = _product(a0[small], a1[small], b0[small], b1[small])
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= distance)
            forest.link(i[near], j[near])
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0) or level == 64:
            continue  # at level 64 a range holds one fingerprint, so every pair was small
        am, bm = split(level, a0, a1), split(level, b0, b1)
        same = a0 == b0
        other = ~same & (diff < distance)
        cross = same & (distance > diff)
        parts = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0[other], am[other], bm[other], b1[other], diff[other] + 1),
            (am[other], a1[other], b0[other], bm[other], diff[other] + 1),
            (a0[cross], am[cross], bm[cross], b1[cross], diff[cross] + 1),
        ]
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        there = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        if there.any():
            stack.append((level + 1, *(x[there] for x in (a0, a1, b0, b1, diff))))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _walks(depth: int, distance: int):
    """Whole node pairs, sorted by (path, a, b, key), to the spanning forest of their links."""

    def forest(rows: pa.Table) -> pa.RecordBatch:
        key, fp = rows["key"].to_numpy().view(np.uint64), rows["fp"].to_numpy()
        path, a, b = (rows[c].to_numpy() for c in ("path", "a", "b"))
        new = np.ones(len(key), bool)
        new[1:] = (path[1:] != path[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(key))
        # a pair of two nodes lies as two runs, one below each; a node with itself as one
        prefix = key >> np.uint64(64 - depth)
        turn = np.flatnonzero(~new[1:] & (prefix[1:] != prefix[:-1])) + 1
        mid = hi.copy()
        mid[np.searchsorted(lo, turn, "right") - 1] = turn
        self_pair = a[lo] == b[lo]
        keep = self_pair | (mid < hi)
        lo, mid, hi, self_pair = lo[keep], mid[keep], hi[keep], self_pair[keep]
        links = Forest(len(key))
        walk(
            key,
            (lo, np.where(self_pair, hi, mid), np.where(self_pair, lo, mid), hi),
            depth,
            distance,
            links,
        )
        at = np.flatnonzero(links.root != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[links.root[at]])], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = n - 1  # the last node pair may go on in the next batch
            last = rows.slice(n - 1).select(["path", "a", "b"]).to_pylist()[0]
            same = np.logical_and.reduce([rows[c].to_numpy() == last[c] for c in last])
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                yield forest(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            n -= whole
        if n:
            yield forest(pa.Table.from_batches(held).combine_chunks())

    return run


def _deal(prints: DataFrame) -> DataFrame:
    """Each fingerprint in four bit orders, below its node at depth ``BLOCK``."""
    fp = F.col("fp")
    turned = [fp] + [
        F.shiftleft(fp, BLOCK * r).bitwiseOR(F.shiftrightunsigned(fp, 64 - BLOCK * r)) for r in range(1, 4)
    ]
    orders = F.array(*[F.struct(F.lit(r).alias("path"), t.alias("key")) for r, t in enumerate(turned)])
    node = F.shiftrightunsigned("key", 64 - BLOCK)
    return prints.select("fp", F.inline(orders)).select("path", node.alias("a"), node.alias("b"), "key", "fp")


def _subtrees(hot: DataFrame, depth: int, distance: int, step: int = 4) -> DataFrame:
    """The walk's next ``step`` levels as a DataFrame: rows go to the pairs of subtrees within the budget."""
    child = F.shiftrightunsigned("key", 64 - depth - step).bitwiseAND(F.lit((1 << step) - 1)).cast("int")
    under_a = F.shiftrightunsigned("key", 64 - depth) == F.col("a")
    other = F.explode(F.sequence(F.lit(0), F.lit((1 << step) - 1)))
    rows = hot.select("*", child.alias("own"), under_a.alias("in_a"), other.alias("other"))
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count(
        F.col("own").bitwiseXOR(F.col("other"))
    )
    rows = rows.where(spent <= distance)
    same, own, far = F.col("a") == F.col("b"), F.col("own"), F.col("other")
    first = F.when(same, F.least(own, far)).when(F.col("in_a"), own).otherwise(far)
    second = F.when(same, F.greatest(own, far)).when(F.col("in_a"), far).otherwise(own)
    return rows.select(
        "path",
        (F.shiftleft("a", step) + first).alias("a"),
        (F.shiftleft("b", step) + second).alias("b"),
        "key",
        "fp",
    )


def links(prints: DataFrame, distance: int = DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints ``fp``."""
    if distance > 3:
        raise ValueError("four blocks prove links of at most three bits")
    pairs, depth, found = _deal(prints), BLOCK, []
    key = ["path", "a", "b"]
    while True:
        below = F.shiftrightunsigned("key", 64 - depth)
        counts = pairs.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), (F.min(below) != F.max(below)).alias("two")
        )
        # two nodes need fingerprints below both; one node needs two fingerprints
        live = counts.where((F.col("a") == F.col("b")) & (F.col("n") > 1) | F.col("two"))
        large = live.where(F.col("n") > node_rows).select(*key) if depth < 64 else None
        hot = large is not None and not large.isEmpty()
        small = pairs.join(large, key, "left_anti") if hot else pairs
        found.append(
            small.repartition(*key)
            .sortWithinPartitions(*key, "key")
            .mapInArrow(_walks(depth, distance), "a bigint, b bigint")
        )
        if not hot:
            break
        pairs = checkpoint(_subtrees(pairs.join(large, key, "left_semi"), depth, distance))
        depth += 4
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE
) -> DataFrame:
    """The fingerprint and the class of every row: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; shingles are ``words`` words
    joined by one space, repeats included. A shorter text is one shingle, a text without words
    has fingerprint zero. Shingles are hashed by XXH64 (seed 42); a bit is 1 if more than half of
    the hashes have it. Fingerprints link at ``distance`` or fewer differing bits, and a class is
    all that links reach; it is named by its smallest id.

    A null text counts as empty. Rows that repeat an id each get a row. A null id takes part
    and stays null; a class whose ids are all null has a null component_id. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = texts(df, id_col, text_col)
    prints = checkpoint(docs.mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint"))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    root = components(links(distinct.select("fp"), distance), "a", "b")
    named = distinct.join(root, distinct.fp == root.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    # links are few, so most fingerprints are their own class and need no second pass
    classes = checkpoint(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = checkpoint(named.join(classes, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
