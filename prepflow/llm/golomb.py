"""Golomb-Rice codes of sorted integers, with the unary and the binary parts in separate streams."""

from __future__ import annotations

import struct

import numpy as np

HEAD, HEAD_SIZE = "<IBI", 9  # how many, bits of a remainder, bytes of the unary stream


def encode(values: np.ndarray) -> bytes:
    """Ascending distinct unsigned 64-bit integers, each as its distance from the one before."""
    n = len(values)
    if not n:
        return struct.pack(HEAD, 0, 0, 0)
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // n  # gaps of hashes are geometric: the best parameter is near their mean
    k = max(0, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    else:
        rest = np.zeros(0, np.uint8)
    unary = np.packbits(unary).tobytes()
    return struct.pack(HEAD, n, k, len(unary)) + unary + np.packbits(rest).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from(HEAD, code)
    if not n:
        return np.zeros(0, np.uint64)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, HEAD_SIZE))
    stops = np.flatnonzero(unary == 0)[:n]
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=HEAD_SIZE + size), count=n * k).reshape(n, k)
        low = np.zeros(n, np.uint64)
        for j in range(k):
            low = (low << np.uint64(1)) | rest[:, j]
        gaps = (gaps << np.uint64(k)) | low
    return np.cumsum(gaps, dtype=np.uint64)
