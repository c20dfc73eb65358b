"""An exchange of hashed keys between buckets of documents and owners of keys.

Documents lie in buckets, a bucket being what one task holds of them. A bucket sends each owner
the keys it has, once each, as one packed list; an owner is a range of leading key bits. So a
key costs one entry per bucket, however many of its documents have it, and an owner's answer
goes back to the bucket that asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.arrow import raw, text_bytes, width

BUCKET_BYTES = 8 << 20
OWNER_BYTES = 64 << 20


class Layout:
    """How many buckets and owners: from the size of the texts, at least as many as shuffle partitions."""

    def __init__(self, docs: DataFrame):
        size = text_bytes(docs)
        self.buckets = max(2 * width(docs), -(-size // BUCKET_BYTES))
        owners = max(2, width(docs), -(-size // OWNER_BYTES))
        self.bits = (owners - 1).bit_length()

    def bucket(self) -> Column:
        """By id and text, so that a hot id is spread."""
        return F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.buckets)).alias("bucket")


def owner_cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners of ascending keys, and where each one's keys begin and end."""
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64)
    owners, starts = np.unique(owner, return_index=True)
    return owners, np.append(starts, len(keys))


def held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the ascending array ``among``."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def units(table: pa.Table, separators: np.ndarray, trim: np.ndarray | None = None):
    """The runs between separators, all texts of a bucket in one go.

    ``separators`` flags the 256 byte values; a run never crosses texts. Returns the bytes, each
    run's start and end, and the offsets of each text's runs. With ``trim``, flagged bytes
    are cut from both ends of a run, and runs of nothing else are left out.
    """
    data, offsets = raw(table["text"])
    apart = separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = apart[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = apart[1:]
    starts = np.flatnonzero(~apart & (before | first[:-1]))
    ends = np.flatnonzero(~apart & (after | first[1:])) + 1
    if trim is not None and len(starts):
        solid = np.flatnonzero(~trim[data])
        lo = np.searchsorted(solid, starts)
        hi = np.searchsorted(solid, ends)
        keep = hi > lo
        starts, ends = solid[lo[keep]], solid[hi[keep] - 1] + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def window_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """Flags the positions at which a window of ``size`` units lies within one text."""
    n = int(offsets[-1])
    last = np.repeat(offsets[1:], np.diff(offsets)) - size
    return np.arange(n) <= last


def covered(starts: np.ndarray, size: int) -> np.ndarray:
    """Flags the positions that lie in a window whose start is flagged."""
    steps = np.zeros(len(starts) + size + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps)[: len(starts)] > 0
