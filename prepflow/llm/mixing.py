"""Mixing sources: temperature weights, realised as budgeted block permutations.

A source with n tokens gets a weight proportional to n^a. The exponent is bisected (in sixteenths,
all candidates of a round in one aggregate over the sources) until the mixture is as even as
the limit allows: no source repeated more than ``max_repetition`` times, or an entropy of at least
``target_entropy``. A weight times the budget is a source's number of tokens: so many
whole passes, and one partial pass.

A pass is a permutation: rows are ordered by a hash of their content and the pass, whose leading
bits are the block. The partial pass takes rows in that order up to its budget. Where it ends is
found from sums of tokens per block, then per sub-block of the block in which the budget runs
out, and only the rows of that sub-block, about a millionth of the source, are ordered one by one.
The result of all this is one number per source, with which each row decides for itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.session import checkpoint, scratch_path

MAX_REPETITION = 2.0
ROUNDS, SECTIONS = 7, 16
BLOCK_BITS, SUB_BITS, HASH_BITS = 10, 10, 63
REST_BITS = HASH_BITS - BLOCK_BITS - SUB_BITS
PARTIAL = -1  # the pass number of the partial pass


def tokens(text: Column) -> Column:
    """Words between ASCII white space: the measure of shares and budgets."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def order_hash(identity: Column, which: Column, seed: int) -> Column:
    """The place of a row in a pass: 63 bits."""
    return F.xxhash64(identity, which.cast("int"), F.lit(seed)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


@dataclass
class Mixture:
    """The exponent found, and the whole passes of the largest source."""

    exponent: float
    passes: float
    largest: int

    def repetition(self, n: Column) -> Column:
        return self.passes * F.pow(n / F.lit(float(self.largest)), F.lit(self.exponent - 1))


def solve(
    sources: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    budget: int | None = None,
) -> Mixture:
    """Bisect the exponent over ``sources`` (source, n). Without a budget the largest source is read once."""
    n = F.col("n").cast("double")
    first = sources.where("n > 0").agg(F.max("n"), F.min("n"), F.count(F.lit(1))).first()
    largest, smallest, k = first
    if not k:
        return Mixture(1.0, 1.0, 1)
    share = n / F.lit(float(largest))

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        row = (
            sources.where("n > 0")
            .agg(*[F.sum(F.pow(share, F.lit(a)) * x) for a in exponents for x in (F.lit(1.0), F.log(share))])
            .first()
        )
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]

    def passes(total: float) -> float:
        return 1.0 if budget is None else budget / (largest * total)

    def enough(a: float, total: float, logs: float) -> bool:
        """Whether the mixture may be at least as even as ``a`` makes it."""
        if target_entropy is not None:
            return math.log(total) - a * logs / total < target_entropy
        return max_repetition is None or passes(total) * (smallest / largest) ** (a - 1) <= max_repetition

    low, high = 0.0, 1.0  # the exponent wanted is the smallest that is enough: 0 is even, 1 is as found
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        inner = grid[:-1] if low == 0.0 else grid[1:-1]
        found = [a for a, (total, logs) in zip(inner, sums(inner)) if enough(a, total, logs)]
        at = found[0] if found else high
        low, high = max([a for a in grid if a < at], default=0.0), at
        if at == 0.0:
            break
    total, _ = sums([high])[0]
    return Mixture(high, passes(total), largest)


def _ends(rows: DataFrame, sums: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """The digit at which each budget runs out, and what is left of it there."""
    along = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(sums, keys)
        .withColumn("upto", F.sum("n").over(along))
        .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        .select(*keys, digit, (F.col("left") - F.col("upto") + F.col("n")).alias("left"))
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repetition: float | None = MAX_REPETITION,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 17,
    copy_col: str = "copy",
    block_col: str = "block",
) -> DataFrame:
    """The rows of the mixture: all columns of ``df``, the pass each row belongs to, and its block there.

    ``target_entropy`` (in nats) goes before ``max_repetition``. Without a ``budget`` (in tokens) the
    largest source is read exactly once and every other at least once, so no row is lost; with
    one, sources are cut to it. Reading in the order of (copy, block) reads permuted blocks.

    A null source is a source of its own. Sources without any token are read once. Rows that
    repeat, id and text alike, share a place in the order and go in or stay out together in the partial pass;
    a null text has no tokens. ``copy_col`` and ``block_col`` replace columns of those names. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    source = F.struct(F.col(f"`{source_col}`").cast("string").alias("s"))  # a struct is never null
    identity = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    place = order_hash(F.col("identity"), F.lit(PARTIAL), seed)
    rows = checkpoint(
        df.select(
            source.alias("source"), identity.alias("identity"), tokens(F.col(f"`{text_col}`")).alias("n")
        )
        .withColumn("h", place)
        .select(
            "source",
            F.shiftright("h", HASH_BITS - BLOCK_BITS).alias("block"),
            F.shiftright("h", REST_BITS).bitwiseAND(F.lit((1 << SUB_BITS) - 1)).alias("sub"),
            "h",
            "n",
        )
    )
    blocks = checkpoint(rows.groupBy("source", "block").agg(F.sum("n").alias("n")))
    sources = checkpoint(blocks.groupBy("source").agg(F.sum("n").alias("n")))
    mixture = solve(sources, max_repetition, target_entropy, budget)
    wanted = F.round(F.col("n") * mixture.repetition(F.col("n"))).cast("bigint")
    targets = checkpoint(
        sources.select(
            "source",
            F.when(F.col("n") > 0, F.expr("n")).otherwise(1).alias("n"),
            F.when(F.col("n") > 0, wanted).otherwise(1).alias("wanted"),
        ).select(
            "source", F.floor(F.col("wanted") / F.col("n")).alias("whole"), (F.col("wanted") % F.col("n")).alias("left")
        )
    )
    partial = targets.where(F.col("left") > 0).select("source", "left")
    first = checkpoint(_ends(partial, blocks, ["source"], "block"))
    subs = rows.join(first.select("source", "block"), ["source", "block"]).groupBy("source", "block", "sub").agg(F.sum("n").alias("n"))
    second = checkpoint(_ends(first, subs, ["source", "block"], "sub"))
    upto = F.sum("n").over(Window.partitionBy("source", "block", "sub").orderBy("h"))  # rows alike share a sum
    last = (
        rows.join(second, ["source", "block", "sub"])
        .withColumn("upto", upto)
        .where(F.col("upto") <= F.col("left"))
        .groupBy("source")
        .agg(F.max("h").alias("last"))
    )
    start = F.shiftleft(F.shiftleft("block", SUB_BITS) + F.col("sub"), REST_BITS) - 1
    cuts = targets.join(second.select("source", start.alias("start")), "source", "left").join(last, "source", "left")
    path = scratch_path(spark, "cuts")
    cuts.select(
        F.col("source").alias("cut_source"), "whole", F.coalesce("last", "start", F.lit(-1)).alias("cut")
    ).write.parquet(path)
    cuts = spark.read.parquet(path)  # a row per source; its size is known, so Spark picks the join

    keep = [c for c in df.columns if c not in (copy_col, block_col)]
    carried = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")  # whatever the columns are called
    dealt = df.select(carried, source.alias("source"), identity.alias("identity"))
    taken = F.when(order_hash(F.col("identity"), F.lit(PARTIAL), seed) <= F.col("cut"), 1).otherwise(0)
    copies = (F.col("whole") + taken).cast("int")
    passes = (
        dealt.join(cuts, F.col("source") == F.col("cut_source"))
        .select("row", "identity", "whole", copies.alias("copies"))
        .where("copies > 0")
        .select("row", "identity", "whole", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
    number = F.when(F.col("copy") < F.col("whole"), F.col("copy")).otherwise(PARTIAL)
    block = F.shiftright(order_hash(F.col("identity"), number, seed), HASH_BITS - BLOCK_BITS).cast("int")
    return passes.select(
        *[F.col("row").getField(c).alias(c) for c in keep], F.col("copy").alias(copy_col), block.alias(block_col)
    )
