"""Connected components of a large graph, by alternating stars.

Every round turns each node's neighbourhood into a star around its smallest member, first for
the larger neighbours, then for the smaller ones. Edges never grow in number, and the rounds
needed grow with the logarithm of the longest path. Minima are aggregated before they are
shuffled and joined back by a shuffled join whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.session import checkpoint

MAX_ROUNDS = 64


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _smallest(pairs: DataFrame) -> DataFrame:
    """The smallest ``v`` of each ``u``, on its own files: the join that follows deals both sides anew."""
    return checkpoint(pairs.groupBy("u").agg(F.min("v").alias("m")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the links ``a`` - ``b``; the root is the smallest node reachable.

    Links of a node to itself give that node alone; null ends are left out; no links, no rows.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = checkpoint(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    alone = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    before = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _smallest(both)
        large = both.where(F.col("v") > F.col("u")).join(nearest, "u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")
        )
        large = checkpoint(large.distinct())
        nearest = _smallest(large)
        small = large.join(nearest, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = checkpoint(small.unionByName(nearest.withColumnRenamed("m", "v")).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    linked = found.unionByName(roots)
    alone = alone.join(linked, "node", "left_anti").select("node", F.col("node").alias("root"))
    return linked.unionByName(alone)
