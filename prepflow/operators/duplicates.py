"""Rows equal in every column: counted, and dropped, without moving the rows that have no copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import col, dbl, nan_to_null

# Share of rows above which looking for copies among suspects is dearer than counting all rows.
SUSPECT_SHARE = 0.1
# The mark table: 2^26 bits, as 2,048 rows of 512 words. Its size does not depend on the data.
SLOT_BITS, WORD_BITS, ROW_BITS = 26, 6, 15
NARROW = 32  # bytes of a row up to which a hash is no smaller


def row_key(df: DataFrame) -> Column:
    """A 64-bit row hash that agrees for rows that compare equal (0.0 and -0.0 included)."""
    cells = [
        dbl(f.name) + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name)
        for f in df.schema
    ]
    return F.xxhash64(*cells)


def count_duplicates(df: DataFrame, suspect_share: float | None = None) -> tuple[int, int]:
    """(rows, rows beyond the first copy), exact, nulls equal.

    A row whose 64-bit hash is unique has no copy, so the first job shuffles 8 bytes per
    row. Only rows that share a hash are then compared in full, picked out by a join while they
    are at most ``suspect_share`` of all.
    """
    df = nan_to_null(df)
    hashed = df.withColumn("__h", row_key(df))
    tally = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("c"))
    row = tally.agg(F.sum("c"), F.sum(F.when(F.col("c") > 1, F.col("c")))).first()
    total, suspects = int(row[0] or 0), int(row[1] or 0)
    if suspects == 0:
        return total, 0
    pool = df
    if suspects <= (SUSPECT_SHARE if suspect_share is None else suspect_share) * total:
        pool = hashed.join(tally.where(F.col("c") > 1).select("__h"), "__h", "left_semi").drop("__h")
    counted = pool.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    copies = counted.agg(F.sum(F.col("__n") - 1)).first()[0]
    return total, int(copies or 0)


def _slot(h: Column) -> tuple[Column, Column, Column]:
    """Where a hash is marked: row of the table, word in the row, bit in the word."""
    slot = h.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    word = F.shiftright(slot, WORD_BITS).bitwiseAND(F.lit((1 << (ROW_BITS - WORD_BITS)) - 1)).cast("int")
    return F.shiftright(slot, ROW_BITS).cast("int"), word, slot.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")


def _marks(hashes: DataFrame) -> DataFrame:
    """The hashes ``h`` that occur more than once, as bits: at most 2,048 rows of 4 KB (``row``, ``words``)."""
    shared = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    row, word, bit = _slot(F.col("h"))
    words = shared.groupBy(row.alias("row"), word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")
    )
    found = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("set"))
    every = F.sequence(F.lit(0), F.lit((1 << (ROW_BITS - WORD_BITS)) - 1))
    return found.select(
        "row", F.transform(every, lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("bigint"))).alias("words")
    )


def mark_copies(df: DataFrame, mark: str = "__suspect") -> DataFrame:
    """``df`` with a flag that is true for every row that has a copy, and for few others.

    Row hashes go to their owners, eight bytes a row, which answer with one bit table of fixed size; the
    rows themselves stay where they are. Among s hashes that occur more than once, a row without a
    copy is flagged with a chance of s / 2^26.
    """
    hashed = df.withColumn("__h", row_key(df))
    row, word, bit = _slot(F.col("__h"))
    placed = hashed.select("*", row.alias("__row"), word.alias("__word"), bit.alias("__bit"))
    marks = F.broadcast(_marks(hashed.select(F.col("__h").alias("h"))).withColumnsRenamed({"row": "__r", "words": "__w"}))
    joined = placed.join(marks, F.col("__row") == F.col("__r"), "left")
    is_set = F.call_function("shiftright", F.get("__w", F.col("__word")), F.col("__bit")).bitwiseAND(F.lit(1)) == 1
    return joined.select(*[col(c) for c in df.columns], F.coalesce(is_set, F.lit(False)).alias(mark))


def _row_bytes(df: DataFrame) -> int:
    size = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.StructType)
    return sum(20 if isinstance(f.dataType, wide) else size.get(f.dataType.simpleString(), 8) for f in df.schema)


def drop_copies(df: DataFrame) -> DataFrame:
    """One copy of every distinct row, nulls equal; NaN must be NULL already.

    Rows without a copy go straight through; only rows that ``mark_copies`` flags are shuffled and
    compared, in every column. The plan reads ``df`` three times. A row of a few plain columns, no larger than
    what would be sent for it, is compared at once.
    """
    if _row_bytes(df) <= NARROW:
        return df.dropDuplicates()
    marked = mark_copies(df)
    columns = [col(c) for c in df.columns]
    alone = marked.where(~F.col("__suspect")).select(*columns)
    return alone.unionAll(marked.where("__suspect").select(*columns).dropDuplicates())
