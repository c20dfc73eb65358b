"""Hard-negative mining over candidate blocks in Hilbert order, chosen by zone maps.

Candidates are ordered by label and, within a label, along a Hilbert curve through all dimensions,
and written as Parquet, a row per block of at most ``BLOCK_ROWS`` neighbours: packed ids, labels and
vectors, and beside them the zone map, the smallest and largest label and entry per dimension.
Interval arithmetic on a zone map bounds the scores of a block from both sides. An anchor needs

- for its positives, blocks that may hold its label and whose upper bound reaches the bar, the
  score of the last of as many rows of its label in its own block;
- for the negatives of a window of scores, blocks that may hold another label and whose interval
  meets the window between the bar and its upper end. The bar is the score of the last of as many
  rows found in one block of each page of zone maps, that whose middle comes nearest to the upper end.

Zone maps are read alone and met by pages of anchors. An anchor is sent once to each shelf of
``SHELF`` blocks of which it needs some, with a bit for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.llm.arrow import width
from prepflow.session import checkpoint, scratch_path

BLOCK_ROWS = 1 << 10
SHELF = 64  # blocks
PAGE_SHELVES = 64  # shelves whose zone maps are one page
PAGE_ANCHORS = 1 << 14
BITS = 4  # of each dimension in the Hilbert index
SMALL = 1 << 53  # products that doubles hold exactly
LOWEST, HIGHEST = -(2**63), 2**63 - 1

BLOCKS = (
    "shelf bigint, slot int, n int, label_low bigint, label_high bigint, low array<bigint>, high array<bigint>, "
    "ids binary, labels binary, vectors binary, kind string"
)
ANCHORS = "anchor_key bigint, anchor_id bigint, label bigint, vector binary, bar bigint"


def whole(embedding: Column, factor: int) -> Column:
    """floor(factor * x) of every component as long; null if one is null, not finite or too large for a long."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    limit = F.lit(float(2**62) / factor)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= limit))
    return F.when(embedding.isNotNull() & ~bad, F.transform(values, lambda x: F.floor(x * factor).cast("bigint")))


# The order.


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of ``cells`` (0 to 2^bits - 1 per dimension) on a Hilbert curve, as sortable bytes.

    Gray-code form: from the highest bit down, a set bit inverts the lower bits of the first dimension, an
    unset one exchanges them with its own; what is left is decoded by running parities.
    """
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    if not d:
        return [b""] * len(cells)
    for b in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(d):
            is_set = (x[i] & bit) != 0
            swap = np.where(is_set, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(is_set, below, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << b)) != 0, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of longs as rows, shorter ones padded with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), d), np.int64)
    at = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _places(d: int, low: list[int], high: list[int]):
    """A row's place on the curve; every dimension's range is cut into 2^BITS equal cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.array(low, float)
        span = np.maximum(np.array(high, float) - start, 1.0)
        for batch in batches:
            rows = _matrix(batch["vector"], d)
            cells = np.minimum((rows - start) / span * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            columns = [batch["vec_id"], batch["label"], batch["vector"], pa.array(hilbert(cells), pa.binary()), batch["at"]]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "place", "at"])

    return run


def _smallest_kind(rows: np.ndarray) -> str:
    for kind in ("int16", "int32"):
        info = np.iinfo(kind)
        if rows.size == 0 or rows.min() >= info.min and rows.max() <= info.max:
            return kind
    return "int64"


def _cut(d: int, block_rows: int):
    """Rows in order to blocks; the blocks of a task are numbered through, ``SHELF`` to a shelf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            vectors = _matrix(rows["vector"], d)
            labels = rows["label"].to_numpy()
            kind = _smallest_kind(vectors)
            values = {
                "shelf": [(part << 32) + number // SHELF], "slot": [number % SHELF], "n": [len(labels)],
                "label_low": [labels.min()], "label_high": [labels.max()],
                "low": [vectors.min(axis=0)], "high": [vectors.max(axis=0)],
                "ids": [rows["vec_id"].to_numpy().tobytes()], "labels": [labels.tobytes()],
                "vectors": [vectors.astype(kind).tobytes()], "kind": [kind],
            }
            number += 1
            return pa.RecordBatch.from_pydict(values, schema=BLOCK_SCHEMA)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block_rows:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield block(rows.slice(0, block_rows))
                held, n = [rows.slice(block_rows)], n - block_rows
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


_LONGS = pa.list_(pa.int64())
BLOCK_SCHEMA = pa.schema(
    [
        ("shelf", pa.int64()), ("slot", pa.int32()), ("n", pa.int32()), ("label_low", pa.int64()),
        ("label_high", pa.int64()), ("low", _LONGS), ("high", _LONGS), ("ids", pa.binary()), ("labels", pa.binary()),
        ("vectors", pa.binary()), ("kind", pa.string()),
    ]
)


def write_blocks(rows: DataFrame, path: str, block_rows: int) -> int:
    """Write ``rows`` (vec_id, label, vector) in blocks; returns the number of dimensions, -1 without rows."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return -1
    d = int(longest)
    entries = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at")
    box = entries.agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
    # of rows equal in everything the last column keeps the order total, so that no key is too hot to split
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    placed = rows.mapInArrow(
        _places(d, [r["low"] for r in box], [r["high"] for r in box]),
        "vec_id bigint, label bigint, vector array<bigint>, place binary, at bigint",
    )
    order = ["label", "place", "vec_id", "at"]
    placed = placed.repartitionByRange(width(rows), *order).sortWithinPartitions(*order)
    placed.select("vec_id", "label", "vector").mapInArrow(_cut(d, block_rows), BLOCKS).write.parquet(path)
    return d


# Scores and bounds.


def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """As doubles where every score is exact in them, else as Python integers. The first is scored with the others."""
    top = [int(max(abs(int(a.min())), abs(int(a.max())))) if a.size else 0 for a in arrays]
    d = max(1, arrays[0].shape[1])
    kind = float if top[0] * max(top[1:]) * d < SMALL else object
    return [a.astype(kind) for a in arrays]


def _clipped(scores: np.ndarray) -> np.ndarray:
    """As longs; what lies beyond them becomes the nearest one."""
    if scores.dtype == object:
        return np.array([min(max(int(s), LOWEST), HIGHEST) for s in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def intervals(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest score of each anchor (rows) within each box (columns)."""
    anchors, low, high = _numbers(anchors, low, high)
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _clipped(up @ low.T + down @ high.T), _clipped(up @ high.T + down @ low.T)


def _stack(column, d: int) -> np.ndarray:
    rows = [np.frombuffer(v.as_buffer(), np.int64) for v in column]
    return np.array(rows, np.int64).reshape(len(rows), d)


def _lists(column) -> list[np.ndarray]:
    return [np.array(v, np.int64) for v in column.to_pylist()]


def _anchors(d: int, every: int, wanted: int):
    """The anchors among the rows of each block, with the bar that the block's own rows of their label set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ids, labels, vectors = _payload(batch, i, d)
                mine = np.flatnonzero(ids % every == 0)
                for at in range(0, len(mine), 256):
                    part = mine[at : at + 256]
                    a, rows = _numbers(vectors[part], vectors)
                    scores = _clipped(a @ rows.T)
                    for row, s in zip(part, scores):
                        same = labels == labels[row]
                        same[row] = False
                        s = s[same]
                        bar = int(np.partition(s, len(s) - wanted)[len(s) - wanted]) if len(s) >= wanted else LOWEST
                        key = _row_key(batch["shelf"][i].as_py(), batch["slot"][i].as_py(), int(row))
                        out.append((key, int(ids[row]), int(labels[row]), vectors[row].tobytes(), bar))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            names = ["anchor_key", "anchor_id", "label", "vector", "bar"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _row_key(shelf: int, slot: int, row: int) -> int:
    """Names one row of all blocks: task (22 bits), shelf (20), slot (6), row (16, so blocks hold 65,536 rows at most)."""
    return ((shelf >> 32) << 42) + ((shelf & 0xFFFFFFFF) << 22) + (slot << 16) + row


def _payload(batch, i: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch["ids"][i].as_buffer(), np.int64)
    labels = np.frombuffer(batch["labels"][i].as_buffer(), np.int64)
    vectors = np.frombuffer(batch["vectors"][i].as_buffer(), batch["kind"][i].as_py()).astype(np.int64)
    return ids, labels, vectors.reshape(len(ids), d)


# Which blocks an anchor needs.


def _choose(d: int, positives: bool, probe: bool):
    """A page of zone maps and a page of anchors to the shelves that each anchor needs, a bit per block."""

    def run(zones: pa.Table, anchors: pa.Table) -> pa.Table:
        needs = np.zeros((anchors.num_rows, zones.num_rows), bool)
        if anchors.num_rows and zones.num_rows:
            low, high = (_matrix(zones[c].combine_chunks(), d) for c in ("low", "high"))
            label_low, label_high = (zones[c].to_numpy() for c in ("label_low", "label_high"))
            label = anchors["label"].to_numpy()[:, None]
            least, most = intervals(_stack(anchors["vector"], d), low, high)
            if positives:
                needs = (most >= anchors["bar"].to_numpy()[:, None]) & (label_low <= label) & (label <= label_high)
            else:
                fits = (label_low != label) | (label_high != label)
                for i, (lows, tops) in enumerate(zip(_lists(anchors["lows"]), _lists(anchors["tops"]))):
                    meets = (most[i] >= lows[:, None]) & (least[i] <= tops[:, None]) & fits[i]
                    if probe and meets.any():  # of each window the block whose middle comes nearest to its upper end
                        far = np.abs(most[i] / 2 + least[i] / 2 - tops[:, None])
                        nearest = np.where(meets, far, np.inf).argmin(axis=1)
                        needs[i, nearest[meets.any(axis=1)]] = True
                    else:
                        needs[i] = meets.any(axis=0)
        shelf, slot = zones["shelf"].to_numpy(), zones["slot"].to_numpy()
        shelves, place = np.unique(shelf, return_inverse=True)
        bits = np.zeros((anchors.num_rows, len(shelves)), np.uint64)
        for j in range(len(shelf)):
            bits[:, place[j]] |= needs[:, j].astype(np.uint64) << np.uint64(slot[j])
        row, at = np.nonzero(bits)
        out = anchors.drop_columns(["zone_page"]).take(pa.array(row))
        for name in {"lows", "tops"} & set(out.column_names):  # as lists that may hold nulls, as declared
            out = out.set_column(out.column_names.index(name), name, out[name].cast(_LONGS))
        out = out.append_column("shelf", pa.array(shelves[at].astype(np.int64)))
        return out.append_column("wanted", pa.array(bits[row, at].view(np.int64)))

    return run


# What is read.


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) <= k:
        return np.arange(len(ids))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]  # ~ turns the order of longs, without overflow


def _read(d: int, positives: bool, k: int):
    """A shelf's blocks and the anchors that need some of them to the k best rows of each anchor or window."""

    def run(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[int, list] = {i: [] for i in range(anchors.num_rows)}
        if anchors.num_rows and blocks.num_rows:
            asks = _stack(anchors["vector"], d)
            wanted = anchors["wanted"].to_numpy().view(np.uint64)
            label, key = anchors["label"].to_numpy(), anchors["anchor_key"].to_numpy()
            if positives:
                floors = [[b] for b in anchors["bar"].to_pylist()]
                tops = [[HIGHEST]] * len(floors)
            else:
                floors, tops = anchors["lows"].to_pylist(), anchors["tops"].to_pylist()
            for i in range(blocks.num_rows):
                slot = blocks["slot"][i].as_py()
                asking = np.flatnonzero((wanted >> np.uint64(slot)) & np.uint64(1))
                if not len(asking):
                    continue
                ids, labels, vectors = _payload(blocks, i, d)
                for at in range(0, len(asking), 256):
                    part = asking[at : at + 256]
                    a, rows = _numbers(asks[part], vectors)
                    for j, s in zip(part, _clipped(a @ rows.T)):
                        fits = (labels == label[j]) if positives else (labels != label[j])
                        if positives:
                            fits &= np.array([_row_key(blocks["shelf"][i].as_py(), slot, 0)]) + np.arange(len(ids)) != key[j]
                        for w, (floor, top) in enumerate(zip(floors[j], tops[j])):
                            take = np.flatnonzero(fits & (s >= floor) & (s <= top))
                            if len(take):
                                take = take[_best(ids[take], s[take], k)]
                                out[j].append((w, ids[take], s[take]))
        columns: list[list] = [[], [], [], []]
        for j, found in out.items():
            for w in {f[0] for f in found}:
                ids = np.concatenate([f[1] for f in found if f[0] == w])
                scores = np.concatenate([f[2] for f in found if f[0] == w])
                best = _best(ids, scores, k)
                for column, values in zip(columns, (np.full(len(best), j), np.full(len(best), w), ids[best], scores[best])):
                    column.append(values)
        row, window, ids, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        keys = anchors["anchor_key"].to_numpy()[row] if len(row) else row
        names = ["anchor_key", "window", "vec_id", "score"]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (keys, window, ids, scores)], names=names)

    return run


FOUND = "anchor_key bigint, window bigint, vec_id bigint, score bigint"


class Shelves:
    """The blocks at ``path``, and how anchors meet them."""

    def __init__(self, spark, path: str, d: int, anchors: int):
        self.blocks, self.d = spark.read.parquet(path), d
        shelves = self.blocks.select("shelf").distinct().count()
        self.zone_pages = max(1, -(-shelves // PAGE_SHELVES))
        self.anchor_pages = max(1, -(-anchors // PAGE_ANCHORS))

    def choose(self, anchors: DataFrame, positives: bool, probe: bool = False) -> DataFrame:
        """Anchors beside the shelves that they need: two columns more, shelf and wanted."""
        page = F.pmod(F.xxhash64("shelf"), F.lit(self.zone_pages))
        zones = self.blocks.select("shelf", "slot", "label_low", "label_high", "low", "high", page.alias("zone_page"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        zones = zones.select("*", upto(self.anchor_pages).alias("page"))
        own = F.pmod(F.xxhash64("anchor_key"), F.lit(self.anchor_pages)).cast("bigint")
        asked = anchors.select("*", own.alias("page"), upto(self.zone_pages).alias("zone_page"))
        kinds = ", ".join(f"{n} {t}" for n, t in asked.dtypes if n != "zone_page")
        keys = ["zone_page", "page"]
        return zones.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
            _choose(self.d, positives, probe), f"{kinds}, shelf bigint, wanted bigint"
        )

    def read(self, asked: DataFrame, positives: bool, k: int) -> DataFrame:
        """The k best rows per anchor and window of what ``choose`` gave, over all shelves."""
        asked = checkpoint(asked)
        # a page of its own name: a column that both sides of a cogroup have from one table is ambiguous
        some = asked.select("shelf", F.col("page").alias("of")).distinct().select("shelf", (F.col("of") + 0).alias("page"))
        blocks = self.blocks.drop("label_low", "label_high", "low", "high", "n").join(some, "shelf")
        keys = ["shelf", "page"]
        found = blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_read(self.d, positives, k), FOUND)
        best = Window.partitionBy("anchor_key", "window").orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives of every row whose id is divisible by ``every``, for each of its best positives.

    Components become floor(factor * x), scores are integer inner products, ties go to the smaller id.
    Positives are the anchor's first ``positives`` other rows of its label. Of the rows of another label
    with low / 100 <= negative score / positive score <= high / 100 (as low * p <= 100 * n <= high * p, so
    none where the positive score is negative), the first ``negatives`` are returned: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score, anchor_key (names the anchor's
    row) and positive_rank.

    Rows with a null id, label or vector or with a null, non-finite or huge component (2^62 after the factor)
    take no part. Shorter vectors are padded with zeros. Rows that repeat an id or are equal in everything are
    rows of their own: only the anchor's own row is no partner. Scores beyond 64 bits become the nearest
    long. Other columns are ignored. No rows, anchors or positives give an empty result.
    """
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("a block holds 1 to 65,536 rows")
    spark = df.sparkSession
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label_col}`").cast("bigint").alias("label"),
        whole(F.col(f"`{vector_col}`"), factor).alias("vector"),
    ).where("vec_id is not null and label is not null and vector is not null")
    path = scratch_path(spark, "hilbert-blocks")
    d = write_blocks(rows, path, block_rows)
    if d < 0:
        return spark.createDataFrame([], RESULT)
    anchors = checkpoint(spark.read.parquet(path).mapInArrow(_anchors(d, every, positives), ANCHORS))
    shelves = Shelves(spark, path, d, anchors.count())

    best = checkpoint(shelves.read(shelves.choose(anchors, True), True, positives))
    p = F.col("score").cast("decimal(38,0)")
    floor = F.ceil(p * low / 100).cast("bigint")
    top = F.least(F.floor(p * high / 100), F.lit(HIGHEST)).cast("bigint")
    windows = best.select(
        "anchor_key", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"), floor.alias("floor"), top.alias("top"),
    ).where("floor <= top")
    per = windows.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "floor", "top"))).alias("w"))
    asked = anchors.drop("bar").join(per, "anchor_key").select(
        "anchor_key", "label", "vector", F.col("w.floor").alias("lows"), F.col("w.top").alias("tops"),
        F.col("w.positive_rank").alias("ranks"),
    )
    asked = checkpoint(asked)
    probed = shelves.read(shelves.choose(asked.drop("ranks"), False, probe=True), False, negatives)
    # the bar of a window is its last score, if the probes have found as many rows as are wanted
    bars = probed.where(F.col("rank") == negatives).groupBy("anchor_key").agg(
        F.map_from_entries(F.collect_list(F.struct("window", F.col("score").alias("bar")))).alias("bars")
    )
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.try_element_at("bars", i.cast("bigint"))))
    asked = checkpoint(asked.join(bars, "anchor_key", "left").withColumn("lows", raised).drop("bars"))
    found = shelves.read(shelves.choose(asked.drop("ranks"), False), False, negatives).select(
        "anchor_key", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    ranks = asked.select("anchor_key", F.posexplode("ranks").alias("window", "positive_rank"))
    return (
        found.join(ranks, ["anchor_key", "window"])
        .join(windows.drop("floor", "top"), ["anchor_key", "positive_rank"])
        .join(anchors.select("anchor_key", "anchor_id"), "anchor_key")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
            "negative_score", "anchor_key", F.col("positive_rank").cast("int").alias("positive_rank"),
        )
    )


RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, "
    "anchor_key bigint, positive_rank int"
)
