"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Vectors are dealt into shards. A shard's tree is split at medians of its widest dimension until
leaves hold ``LEAF_ROWS`` vectors, and every node keeps the tight bounding box of its vectors.
The largest inner product that a box allows is the sum over dimensions of the larger of
query times lower and query times upper bound. A query walks a tree best bound first, scores
whole leaves, and stops at the first node whose bound is below the k-th best score known.

The k-th score travels: a query is searched in its own shard first, and the score of its k-th
result there is the bar that it carries into all other shards, where most nodes then fall. Queries
meet shards in blocks of bounded size: a task holds one shard and one block of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.llm.arrow import raw, width
from prepflow.session import checkpoint

SHARD_ROWS = 1 << 16  # at most, about; fewer while there are fewer shards than shuffle partitions
LEAST_ROWS = 1 << 9
QUERY_ROWS = 1 << 15  # queries that meet a shard at a time, about
LEAF_ROWS = 128
SMALL = 1 << 53  # products that doubles hold exactly
LOWEST = np.iinfo(np.int64).min
FOUND = "query_id bigint, vec_id bigint, score bigint, bar bigint"


def quantised(embedding: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component x as double; null if one is null or not finite."""
    whole = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(
        whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.when(embedding.isNotNull() & ~bad, F.transform(whole, lambda x: F.floor(x * factor).cast("bigint")))


class Tree:
    """The nodes of one shard: children, row ranges, and boxes as two matrices."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.left, self.right, self.begin, self.end, low, high = [], [], [], [], [], []
        todo = [(0, len(ids), -1, False)]
        while todo:
            lo, hi, parent, is_right = todo.pop()
            here = rows[order[lo:hi]]
            node = len(self.begin)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            self.begin.append(lo)
            self.end.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            low.append(here.min(axis=0))
            high.append(here.max(axis=0))
            widest = int(np.argmax(high[-1].astype(float) - low[-1])) if here.shape[1] else 0
            if hi - lo > leaf and here.shape[1] and high[-1][widest] > low[-1][widest]:
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(here[:, widest], middle, kind="introselect")]
                todo += [(lo, lo + middle, node, False), (lo + middle, hi, node, True)]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, the largest score that the node's box allows."""
        zero = queries.dtype.type(0)
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, bar) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, smaller ids first among equals; none that is below ``bar``."""
        ids, scores = self.ids[:0], np.zeros(0, self.rows.dtype)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= bar:
            _, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= bar:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            part = slice(self.begin[node], self.end[node])
            new = self.rows[part] @ query
            take = (new >= bar) & (self.ids[part] != own)
            ids = np.concatenate([ids, self.ids[part][take]])
            scores = np.concatenate([scores, new[take]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bar = max(bar, scores.min())
        return ids, scores


def _matrix(vectors, dimensions: int) -> np.ndarray:
    """Vectors as rows, padded with zeros; doubles where every score is exact in them, else Python integers."""
    out = np.zeros((len(vectors), dimensions), np.int64)
    data, offsets = raw(vectors)
    values = np.frombuffer(data.tobytes(), np.int64)
    offsets = offsets // 8
    sizes = np.diff(offsets)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values
    return out


def _exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = int(np.abs(rows.astype(float)).max(initial=0)) * int(np.abs(queries.astype(float)).max(initial=0))
    kind = float if most * max(1, rows.shape[1]) < SMALL else object
    return rows.astype(kind), queries.astype(kind)


def _clipped(scores: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what lies beyond them becomes the nearest one."""
    info = np.iinfo(np.int64)
    if scores.dtype == object:
        return np.array([min(max(int(s), info.min), info.max) for s in scores], np.int64)
    return scores.astype(np.int64)


def _search(dimensions: int, k: int):
    """Search one shard for blocks of queries: a row has a shard's vectors, or a block of queries."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = vectors["vec_id"].to_numpy()
        asked, bars = queries["query_id"].to_numpy(), queries["bar"].to_numpy()
        out = []
        if len(ids) and len(asked):
            rows, asks = _exact(_matrix(vectors["vector"], dimensions), _matrix(queries["ask"], dimensions))
            tree = Tree(ids, rows)
            for at in range(0, len(asked), 256):
                bounds = tree.bounds(asks[at : at + 256])
                for i in range(at, min(at + 256, len(asked))):
                    bar = -np.inf if bars[i] == LOWEST else asks.dtype.type(bars[i]) if asks.dtype != object else int(bars[i])
                    found, scores = tree.search(asks[i], asked[i], bounds[i - at], k, bar)
                    scores = _clipped(scores)
                    kth = scores.min() if len(scores) == k else LOWEST
                    out.append((np.full(len(found), asked[i]), found, scores, np.full(len(found), kth)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "bar"]
        )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as packed 64-bit integers."""
    for batch in batches:
        lists = batch["vector"]
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.values.to_numpy()[: ends[-1]] if len(ends) else np.zeros(0, np.int64))
        blobs = [values[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(blobs, pa.binary())], names=["vec_id", "vector"]
        )


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def top_k(
    df: DataFrame,
    k: int = 20,
    every: int = 20,
    factor: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k best other rows for every row whose id is divisible by ``every``, by integer inner product.

    Components become floor(factor * x). Returns query_id, rank (from 1), vec_id and score, ties to the
    smaller id; all others if there are fewer than k. A vector that is null or has a null or
    non-finite component takes no part, nor has a row without an id. An id names one vector: of rows that repeat
    it the smallest vector counts. Shorter vectors are padded with zeros. Scores beyond 64
    bits become the nearest integer that fits. Other columns are ignored; an empty table or one without
    queries gives an empty result.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), quantised(F.col(f"`{vector_col}`"), factor).alias("vector")
    ).where("vec_id is not null and vector is not null")
    vectors = checkpoint(
        rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).mapInArrow(_pack, "vec_id bigint, vector binary")
    )
    is_query = F.col("vec_id") % every == 0
    n, asked, longest = vectors.agg(
        F.count(F.lit(1)), F.count_if(is_query), F.max(F.length("vector"))
    ).first()
    shards = max(1, -(-n // shard_rows), min(width(df), n // LEAST_ROWS))
    blocks = max(1, -(-asked // query_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
    # salted, so that the block of a query does not follow from its shard
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    query = vectors.where(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("ask"), shard.alias("home"), block.alias("block")
    )
    dealt = vectors.select("vec_id", "vector", shard.alias("shard"), F.explode(_upto(blocks)).alias("block"))
    by_shard, search = dealt.groupBy("shard", "block"), _search((longest or 0) // 8, k)

    def found(asks: DataFrame) -> DataFrame:
        return by_shard.cogroup(asks.groupBy("shard", "block")).applyInArrow(search, FOUND)

    lowest = F.lit(LOWEST).alias("bar")
    at_home = checkpoint(found(query.select("query_id", "ask", lowest, F.col("home").alias("shard"), "block")))
    bars = at_home.groupBy("query_id").agg(F.max("bar").alias("bar"))
    away = (
        query.join(bars, "query_id", "left")
        .select(
            "query_id", "ask", F.coalesce("bar", lowest).alias("bar"), "home", "block",
            F.explode(_upto(shards)).alias("shard"),
        )
        .where(F.col("shard") != F.col("home"))
        .drop("home")
    )
    every_found = at_home.unionByName(found(away)) if shards > 1 else at_home
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        every_found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
