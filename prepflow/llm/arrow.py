"""Small helpers for functions that run on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The id and the text under fixed names, whatever other columns the table has; null texts are empty."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary Arrow column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks keeps a chunked array when it has no chunk
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbers(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed into a binary column, all rows in one array, and each row's offsets in it."""
    data, offsets = raw(column)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), offsets // width


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i holds ``values[offsets[i]:offsets[i + 1]]``."""
    values = np.ascontiguousarray(values)
    ends = (np.asarray(offsets, np.int64) * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)]
    ).cast(pa.binary())


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES):
    """Cut batches so that a slice holds about ``size`` bytes of ``column``; a longer row stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n, c in columns.items()],
        schema=schema,
    )


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: one scan, one number."""
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
