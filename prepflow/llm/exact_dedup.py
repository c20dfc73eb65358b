"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Rows are cut into sender blocks of at most ``BLOCK_ROWS`` rows. A block sorts the distinct
64-bit fingerprints of its texts, cuts them by owner (their leading bits) and sends each owner
one Golomb-coded list. An owner decodes the lists it got, sees which fingerprints came from
more than one block, and answers each list with a bitmap. Rows whose bit is set, or whose
fingerprint repeats within their block, are suspects. Only the suspects' texts are shuffled, and
their bytes are compared. A hot text is one fingerprint per block, however many rows have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm import golomb
from prepflow.llm.arrow import raw, slices, texts, width
from prepflow.session import checkpoint

BLOCK_ROWS = 1 << 17
OWNER_ROWS = 1 << 21  # fingerprints that an owner holds, about
PRINTS = pa.schema(
    [("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary())]
)
LISTS = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("code", pa.binary())])
BITMAPS = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("bits", pa.binary())])
SUSPECTS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("suspect", pa.bool_())]
)


def _digests(batch: pa.RecordBatch) -> pa.Array:
    data, offsets = raw(pc.ascii_lower(batch.column(1)))
    data = memoryview(data)
    shas = [hashlib.sha256(data[s:e]).digest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.array(shas, pa.binary())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId() << 40, 0
    for batch in slices(batches):
        rows = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(part + rows // BLOCK_ROWS), pa.array(part + rows), batch.column(0), _digests(batch)],
            schema=PRINTS,
        )


def _fingerprints(shas) -> np.ndarray:
    data, _ = raw(shas)
    return data.reshape(-1, 32)[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def _send(bits: int):
    """One Golomb-coded list for each owner and sender block; blocks lie whole and in order."""

    def lists(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        prints = np.unique(np.concatenate(held))
        owner = (prints >> np.uint64(64 - bits)).astype(np.int64)
        owners, starts = np.unique(owner, return_index=True)
        low = prints & np.uint64((1 << (64 - bits)) - 1)
        codes = [golomb.encode(x) for x in np.split(low, starts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(owners), pa.array(np.full(len(owners), block)), pa.array(codes, pa.binary())],
            schema=LISTS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            prints = _fingerprints(batch.column(3))
            for block in np.unique(blocks):  # ascending, as the rows are
                if block != now and held:
                    yield lists(now, held)
                    held = []
                now = block
                held.append(prints[blocks == block])
        if held:
            yield lists(now, held)

    return run


def _own(rows: pa.Table) -> pa.Table:
    """Answer every list with a bitmap: which of its fingerprints came from another block too."""
    lists = [golomb.decode(code) for code in rows["code"].to_pylist()]
    prints, times = np.unique(np.concatenate(lists), return_counts=True)
    twice = prints[times > 1]
    bits = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pa.Table.from_arrays([rows["block"], rows["owner"], pa.array(bits, pa.binary())], schema=BITMAPS)


def _receive(bits: int):
    def run(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        prints = _fingerprints(rows["sha"])
        distinct, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        suspect = times > 1
        for own, code in zip(bitmaps["owner"].to_pylist(), bitmaps["bits"].to_pylist()):
            lo, hi = np.searchsorted(owner, [own, own + 1])
            suspect[lo:hi] |= np.unpackbits(np.frombuffer(code, np.uint8), count=hi - lo).astype(bool)
        return pa.Table.from_arrays(
            [rows["row"], rows["doc_id"], rows["sha"], pa.array(suspect[place])], schema=SUSPECTS
        )

    return run


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [_digests(batch), pc.ascii_lower(batch.column(1))], names=["sha", "lowered"]
        )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after lower-casing A-Z only; a null text counts as
    empty, and all empty texts are equal. Of equal texts the row with the largest id stays
    (``keep_id``); where rows repeat that id, one of them stays. A null id is smaller than any other;
    ``keep_id`` is null where all ids of the group are. Other columns are ignored. An empty
    table gives an empty result.
    """
    docs = texts(df, id_col, text_col)
    prints = checkpoint(docs.mapInArrow(_prints, "block bigint, row bigint, doc_id bigint, sha binary"))
    owners = max(2, width(df), -(-prints.count() // OWNER_ROWS))
    bits = (owners - 1).bit_length()
    lists = prints.mapInArrow(_send(bits), "owner bigint, block bigint, code binary")
    bitmaps = lists.groupBy("owner").applyInArrow(_own, "block bigint, owner bigint, bits binary")
    marked = checkpoint(
        prints.groupBy("block")
        .cogroup(bitmaps.groupBy("block"))
        .applyInArrow(_receive(bits), "row bigint, doc_id bigint, sha binary, suspect boolean")
    )
    suspects = marked.where("suspect")
    classes = checkpoint(
        suspects.groupBy("sha").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct("doc_id", (-F.col("row")).alias("order"))).alias("best"),
        )
    )
    ids = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
    moved = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("suspect_id")), "left_semi")
    same = (
        moved.mapInArrow(_lowered, "sha binary, lowered string")
        .groupBy("sha", "lowered")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    )
    proven = (F.col("texts") == 1) & (F.col("n") == F.col("group_size"))
    proof = F.when(proven, F.col("group_size")).otherwise(
        F.raise_error(F.lit("different texts share a digest, or the input changed between two reads"))
    )
    classes = checkpoint(
        classes.join(same, "sha").select(
            "sha", proof.alias("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.order")).alias("stays")
        )
    )
    grouped = suspects.join(classes, "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "sha"
    )
    alone = marked.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return grouped.unionByName(alone).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")
