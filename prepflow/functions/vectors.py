"""Sparse vectors of any width from built-in expressions: nothing per entry of the width is planned or sent.

A vector column is stored as a struct of type, size, indices and values. The JSON functions write it as that
struct, so they make one inside the JVM; reading needs no more than taking the type off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A vector of ``size`` entries, zero but for ``values`` at the ascending ``indices``."""
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values")
    )
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), AS_VECTOR)["v"]


def vector_parts(vector: Column) -> Column:
    """type (0 sparse, 1 dense), size, indices and values of a vector column."""
    return F.unwrap_udt(vector)


def flags_vector(parts: Sequence[tuple[Column, int]]) -> Column:
    """One vector of several parts in a row, each (value, width).

    A part of width 0 is one number. Another is that many flags, of which the one at the value is set;
    none if the value is null or not below the width.
    """
    size, indices, values = 0, [], []
    for value, width in parts:
        if width == 0:
            indices.append(F.array(F.lit(size)))
            values.append(F.array(value.cast("double")))
            size += 1
            continue
        at = value.cast("int")
        hit = (at >= 0) & (at < width)
        nothing = F.array().cast("array<int>")
        indices.append(F.when(hit, F.array(at + F.lit(size))).otherwise(nothing))
        values.append(F.when(hit, F.array(F.lit(1.0))).otherwise(nothing.cast("array<double>")))
        size += width
    return sparse_vector(size, F.concat(*indices), F.concat(*values))
