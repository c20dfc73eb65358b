"""Near-copies by the Jaccard similarity of word shingles: every pair of at least 4/5, exactly.

A document is the set of its hashed shingles; rows with equal sets are one from the start. Two
searches propose pairs of sets, and a pair counts only if its whole sets pass the check:

- SimHash fingerprints of the sets, linked by the self-join of binary tries (``simhash``);
- prefixes: if sets are read in one order of all shingles, two sets within the bound share a
  shingle among the first fifth of each. This misses no pair. Which order is free: shingles that
  many documents have come last, so that a common passage proposes nothing.

Groups are not paired out: first each set meets the smallest one that shares a prefix shingle or
its fingerprint. What the checked links join needs no further check, so the second round proposes
only pairs of sets that still lie in different components, of like size and position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.llm import simhash
from prepflow.llm.arrow import numbers, slices, texts
from prepflow.llm.components import components
from prepflow.llm.exchange import held, units, window_starts
from prepflow.llm.hashing import Hasher
from prepflow.llm.substring_dedup import SPACE
from prepflow.session import checkpoint, scratch_path

WORDS = 5
LOCAL = 3  # documents of ``COUNTED`` bytes of text that share a shingle before a task reports it
COUNTED = 4 << 20
HOT = 16  # reported documents, over all tasks, that make a shingle common; the order only costs time
BITS = 1 << 25  # of the tables that tell which shingles are common and which sets are asked for
SEEN = 1 << 20  # sets a task remembers to have given out
LIKELY = 8  # pairs of each set that are checked before its others
TURNS = 2  # of the likeliest pairs, at most
LEFT = 0.5  # share of the pairs that a turn may leave for another one to follow
VOTES = 1 << 14  # shingles whose bits are counted at a time
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(table: pa.RecordBatch, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the offsets of each text's own."""
    data, starts, ends, offsets = units(table, SPACE)
    hasher = Hasher(0)
    tokens = hasher.runs(LOWER[data], starts, ends)
    hashes = hasher.windows(tokens, words)
    at = np.flatnonzero(window_starts(offsets, words)[: len(hashes)])
    row, hashes = np.searchsorted(offsets, at, "right") - 1, hashes[at]
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < words))  # a shorter text is one shingle
    whole = [hasher.windows(tokens[offsets[i] : offsets[i + 1]], int(n[i]))[0] for i in short]
    row = np.concatenate([row, short])
    hashes = np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(table.num_rows + 1))


def _ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A set's own hash; an empty set is 0."""
    cut = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    ids = [xxhash.xxh64_intdigest(hashes[s:e].tobytes()) if e > s else 0 for s, e in cut]
    return np.array(ids, np.uint64).view(np.int64)


def fingerprints(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if more than half of the set's hashes have it; 0 for an empty set."""
    votes = np.zeros((len(offsets) - 1, 64), np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(hashes), VOTES):
        part, of = hashes[at : at + VOTES], row[at : at + VOTES]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        votes[of[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
    most = votes * 2 > np.diff(offsets)[:, None]
    return np.packbits(most, axis=1).reshape(-1).view(">u8").astype(np.uint64).view(np.int64)


ROWS = "doc_id bigint, text_key string, set_id bigint, fp bigint, keys binary, counts binary"


def _named(words: int):
    """Each row's set and fingerprint; rows without a text key hold the shingles that are common in a task instead."""

    def report(held_back: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held_back), return_counts=True)
        some = counts >= LOCAL
        blobs = [[b.tobytes()] for b in (keys[some], counts[some].astype(np.int64))]
        nothing = [pa.array([None], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*nothing, *[pa.array(b, pa.binary()) for b in blobs]], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, size = [], 0
        for part in slices(batches):
            hashes, offsets = shingle_sets(part, words)
            held_back.append(hashes)
            size += part["text"].nbytes
            none = pa.nulls(part.num_rows, pa.binary())
            found = [pa.array(_ids(hashes, offsets)), pa.array(fingerprints(hashes, offsets)), none, none]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], *found], names=NAMES)
            if size >= COUNTED:
                yield report(held_back)
                held_back, size = [], 0
        if held_back:
            yield report(held_back)

    return run


NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, counts = numbers(batch["keys"], np.int64)[0], numbers(batch["counts"], np.int64)[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def bit_table(keys: DataFrame, name: str):
    """The slots of 64-bit keys as a table of ``BITS`` bits, broadcast once: its size does not depend on the data."""
    # bitmap functions count positions from 1 and give 2^15 bits a row
    slot = F.col(name).bitwiseAND(F.lit(BITS - 1)) + 1
    found = keys.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    bits = np.zeros(BITS >> 3, np.uint8)
    for r in found.toArrow().to_pylist():
        bits[(r["k"] - 1) << 12 : r["k"] << 12] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def in_table(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.uint64) & np.uint64(BITS - 1)
    return ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class _Once:
    """Which sets of a batch a task has not given out yet: copies in a task give one."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(self.seen) > SEEN:
            self.seen.clear()
        new = []
        for i, x in enumerate(ids.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                new.append(i)
        return np.array(new, np.int64)


KEYS = "key bigint, set_id bigint, n int, at int"


def _prefixes(words: int, table, shared=None):
    """The first shingles of each set: by hash, those that are common last.

    The shingles alone, or with their set, its size and the place, but only those that may be ``shared``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, once = table.value, _Once()
        for part in slices(batches):
            hashes, offsets = shingle_sets(part, words)
            ids = _ids(hashes, offsets)
            give = np.zeros(len(ids), bool)
            give[once(ids)] = True
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((hashes, in_table(hashes, common), row))
            place = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
            first = give[row] & (place < (n - (4 * n + 4) // 5 + 1)[row])
            keys = hashes[order]
            if shared is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64))], names=["key"])
                continue
            first = np.flatnonzero(first)
            first = first[in_table(keys[first], shared.value)]
            columns = [keys[first].view(np.int64), ids[row[first]], n[row[first]].astype(np.int32), place[first].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "set_id", "n", "at"])

    return run


def _asked(words: int, table, short: bool):
    """The sets whose id may be asked for: their hashes, or the leading 16 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, once = table.value, _Once()
        for part in slices(batches):
            hashes, offsets = shingle_sets(part, words)
            ids = _ids(hashes, offsets)
            take = once(np.where(in_table(ids, bits), ids, 0))
            take = take[in_table(ids[take], bits) & (np.diff(offsets)[take] > 0)]
            given = (hashes >> np.uint64(48)).astype(np.uint16) if short else hashes
            blobs = [given[offsets[i] : offsets[i + 1]].tobytes() for i in take]
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(blobs, pa.binary())], names=["set_id", "shingles"])

    return run


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sets can share, by the leading bits of all: each value as often as both have it."""
    (a, in_a), (b, in_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(in_a[at_a], in_b[at_b]).sum())


def _near(short: bool):
    """The pairs whose sets have a Jaccard similarity of 4/5 or more, or may have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if short else np.uint64
        for batch in batches:
            near = []
            for a, b in zip(batch["sa"], batch["sb"]):
                a, b = (np.frombuffer(x.as_buffer(), kind) for x in (a, b))
                both = shared_at_most(a, b) if short else int(held(a, b).sum())
                near.append(9 * both >= 4 * (len(a) + len(b)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _checked(docs: DataFrame, pairs: DataFrame, words: int, short: bool) -> DataFrame:
    """The pairs (a, b) of set ids that pass the check; only sets in a pair leave their task."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    table = bit_table(ids, "set_id")
    sets = docs.select("text").mapInArrow(_asked(words, table, short), "set_id bigint, shingles binary")
    # copies in several tasks give equal blobs, of which one is enough
    sets = sets.join(ids.distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("shingles").alias("s"))
    sets = checkpoint(sets)
    a, b = (sets.select(F.col("set_id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")
    return checkpoint(both.mapInArrow(_near(short), "a bigint, b bigint"))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as files, sized by them: a checkpoint keeps Spark's estimate, which every join squares until planning stalls."""
    path = scratch_path(df.sparkSession, "pairs")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs that are near: a bound from a quarter of the bytes first, then the whole sets of those it leaves."""
    if pairs.isEmpty():
        return pairs
    return _written(_checked(docs, _written(_checked(docs, pairs, words, short=True)), words, short=False))


def _may(na: Column, nb: Column, ia: Column, ib: Column) -> Column:
    """Whether sizes allow 4/5, and what is left of both sets behind the shared shingle does."""
    rest = F.least(na - ia, nb - ib)
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * rest >= 4 * (na + nb))


def _enough(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets x and y that share as many prefix shingles as 4/5 demands, and that many times k as many.

    ``shared`` has a row per shingle. A pair within the bound shares t = 4/9 of both sizes. The first k of these lie in both prefixes if n - t + k is at
    most the length of each prefix, n less 4/5 of n, plus 1: so k is t + 1 less 4/5 of the larger size. What is left
    behind the first one must do for t.
    """
    na, nb = F.col("x_n").cast("bigint"), F.col("y_n").cast("bigint")
    left = F.max(F.least(na - F.col("x_at"), nb - F.col("y_at"))).alias("left")
    pairs = shared.groupBy(F.col("x_set_id").alias("a"), F.col("y_set_id").alias("b"), "x_n", "y_n")
    t = F.ceil((4 * (na + nb)) / 9)
    least = t + 1 - F.ceil(4 * F.greatest(na, nb) / 5)
    return pairs.agg(F.count(F.lit(1)).alias("k"), left).where((F.col("k") >= least) & (F.col("left") >= t)).select("a", "b", (F.col("k") / least).alias("k"))


def _rooted(keys: DataFrame, links: DataFrame) -> DataFrame:
    """The keys whose sets do not lie in one component yet, each row with the root of its set."""
    root = checkpoint(components(links, "a", "b"))
    named = keys.drop("root").join(root, keys.set_id == root.node, "left").select(
        "key", "set_id", "n", "at", F.coalesce("root", "set_id").alias("root")
    )
    named = checkpoint(named)
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return checkpoint(named.join(apart.select("key"), "key", "left_semi"))


def _met(keys: DataFrame) -> DataFrame:
    """Sets x and y of different components, once for each key that they share; sizes allow 4/5."""
    # sets within the bound lie in the same or in neighbouring bands of sizes
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.25))
    x, y = (keys.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("set_id", "n", "at", "root")], band.alias("band")) for s in "xy")
    y = y.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    apart = (F.col("x_set_id") < F.col("y_set_id")) & (F.col("x_root") != F.col("y_root"))
    sizes = 5 * F.least("x_n", "y_n") >= 4 * F.greatest("x_n", "y_n")
    return x.join(y, (x.key == y.key) & (x.band == y.band) & apart & sizes)


def _between(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose sets are not linked yet."""
    root = checkpoint(components(links, "a", "b"))
    a, b = (root.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left")
    return named.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "k")


def _joined(docs: DataFrame, pairs: DataFrame, links: DataFrame, words: int) -> DataFrame:
    """``links`` and those that the pairs (a, b, k) add: every pair is checked, or lies in one component.

    A group of near copies proposes many pairs for each of its sets. The ``LIKELY`` of each set that share most are
    checked first, and what these link needs no check any more. A turn that leaves most of the pairs was the
    last, and so is one of which the likeliest are most: these sets do lie apart, or there are few pairs.
    """
    for _ in range(TURNS):
        n = pairs.count()
        sides = pairs.select("*", F.explode(F.array("a", "b")).alias("s"))
        place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("k"), "a", "b"))
        best = _written(sides.withColumn("place", place).where(F.col("place") <= LIKELY).select("a", "b").distinct())
        if 2 * best.count() > n:
            break
        links = links.unionByName(_verified(docs, best, words))
        pairs = _written(_between(pairs.join(best, ["a", "b"], "left_anti"), links))
        if pairs.count() > LEFT * n:
            break
    return links.unionByName(_verified(docs, pairs.select("a", "b"), words))


def _alike(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that the trie join links: the smallest sets of linked fingerprints, and sets of equal ones."""
    sets = rows.select("fp", "set_id").distinct()
    least = checkpoint(sets.groupBy("fp").agg(F.min("set_id").alias("least")))
    equal = sets.join(least, "fp").where("set_id <> least").select(F.col("least").alias("a"), F.col("set_id").alias("b"))
    x, y = (least.select(F.col("fp").alias(f"fp_{s}"), F.col("least").alias(f"set_{s}")) for s in "xy")
    links = simhash.links(least.select("fp"))
    far = links.join(x, links.a == F.col("fp_x")).join(y, links.b == F.col("fp_y"))
    return equal.unionByName(far.select(F.least("set_x", "set_y").alias("a"), F.greatest("set_x", "set_y").alias("b")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The class of every row: doc_id, text_key (SHA-256 of the text), class_id.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; a shorter text is one shingle.
    Texts link at a Jaccard similarity of 4/5 or more between their sets of shingles, and a class is all
    that links reach. Texts without words are one class. Shingles and sets are told apart by 64 hash
    bits. A null text counts as empty, and a row with a null id takes part. The texts are cut five times, and
    twice more for each of up to three turns of the second round that has candidates.
    """
    docs = texts(df, id_col, text_col, text_key(F.col(f"`{text_col}`")).alias("text_key"))
    named = checkpoint(docs.mapInArrow(_named(words), ROWS))
    rows = named.where("text_key is not null").drop("keys", "counts")
    counts = named.where("text_key is null").select("keys", "counts").mapInArrow(_unpacked, "key bigint, n bigint")
    common = bit_table(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT), "key")
    # most keys have one set: only those of several travel with it
    several = docs.select("text").mapInArrow(_prefixes(words, common), "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = bit_table(several.where("n > 1"), "key")
    keys = docs.select("text").mapInArrow(_prefixes(words, common, shared), KEYS)
    low = keys.groupBy("key").agg(F.min(F.struct("set_id", "n", "at")).alias("low"), F.max("set_id").alias("high"))
    low = low.where("low.set_id < high").drop("high")
    keys = checkpoint(keys.join(low, "key").distinct())

    fits = _may(F.col("n"), F.col("low.n"), F.col("at"), F.col("low.at"))
    star = keys.where(F.col("set_id") != F.col("low.set_id")).where(fits)
    star = star.select(F.col("low.set_id").alias("a"), F.col("set_id").alias("b"))
    first = _written(_alike(rows).unionByName(star).distinct())
    links = _verified(docs, first, words)

    keys = _rooted(keys, links)
    more = _enough(_met(keys))
    more = _written(more.join(first, ["a", "b"], "left_anti"))
    links = _joined(docs, more, links, words)

    root = components(links, "a", "b")
    return rows.join(root, rows.set_id == root.node, "left").select(
        "doc_id", "text_key", F.coalesce("root", "set_id").alias("class_id")
    )


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with one row of each class of near-copies: the smallest id, null last, then the smallest text hash.

    Rows equal in id and text are copies like others; of them that with the smallest hash of all columns
    stays. Columns may have any names. An empty table gives an empty result.
    """
    rows = checkpoint(near_copies(df, id_col, text_col, words))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = rows.groupBy("class_id").agg(F.min(order).alias("first"))
    # a name is an id and a text; most name one row, which is the first of its class
    names = rows.groupBy("class_id", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    judged = names.join(first, "class_id").select(
        F.col("doc_id").alias("name_id"), F.col("text_key").alias("name_key"), is_first.alias("stays"), "copies"
    )
    odd = checkpoint(judged.where(~F.col("stays") | (F.col("copies") > 1)))
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("row_id"),
        text_key(F.col(f"`{text_col}`")).alias("row_key"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("row_hash"),
    )
    same = F.col("row_id").eqNullSafe(F.col("name_id")) & (F.col("row_key") == F.col("name_key"))
    found = whole.join(odd, same, "left")
    again = found.where("stays").groupBy("row_id", "row_key").agg(F.min_by("row", "row_hash").alias("row"))
    return found.where("stays is null").select("row.*").unionAll(again.select("row.*"))
