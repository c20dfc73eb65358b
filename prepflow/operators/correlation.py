"""Pearson and Spearman correlation, and the views drawn from the matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.functions.columns import aggregate, col, dbl, local_frame, numeric_columns, sized
from prepflow.functions.moments import pearson
from prepflow.operators.ordering import running_weights
from prepflow.session import checkpoint, scratch_path

# Up to this many columns the cross products are plain sums; beyond it p*p of them would not compile well.
SUMMED_COLUMNS = 16
RANK_ROWS = 1 << 18  # rows of a block at most, whose ranks are multiplied at a time
BLOCK_CELLS = 1 << 21  # values of a block at most
BLOCKS_A_TASK = 4
PIECE = 1 << 20  # distinct values of blocks that are merged at a time, about
FREQUENT = 256  # values sampled for each piece: one that holds more than this share of it is likely a bound
# A centred sum of squares this small beside the raw one is rounding: the column is constant.
ROUNDING = 1e-12

Pair = tuple[str, str]
SUMS = ("n", "si", "sj", "sii", "sjj", "sij")
BLOCKS = pa.schema(
    [("block", pa.int64()), ("c", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("keys", pa.binary()),
     ("counts", pa.binary()), ("seen", pa.binary()), ("codes", pa.binary()), ("some", pa.list_(pa.int64()))]
)
BLOCKS_DDL = "block bigint, c int, n int, d int, keys binary, counts binary, seen binary, codes binary, some array<bigint>"
REQUESTS = pa.schema(
    [("c", pa.int32()), ("r", pa.int32()), ("block", pa.int64()), ("d", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
)
REQUESTS_DDL = "c int, r int, block bigint, d int, keys binary, counts binary"
ANSWERS = pa.schema([("block", pa.int64()), ("c", pa.int32()), ("r", pa.int32()), ("d", pa.int32()), ("ranks", pa.binary())])
ANSWERS_DDL = "block bigint, c int, r int, d int, ranks binary"


def _coefficient(n, si, sj, sii, sjj, sij) -> float | None:
    """r from sums over the rows where both are present."""
    if not n:
        return None
    vi, vj = sii - si * si / n, sjj - sj * sj / n
    if vi <= ROUNDING * sii or vj <= ROUNDING * sjj:
        return None
    return max(-1.0, min(1.0, (sij - si * sj / n) / math.sqrt(vi * vj)))


def _centres(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, float], set[str]]:
    """Rows, column means, and the columns that have gaps."""
    parts = [a for c in columns for a in (F.avg(dbl(c)), F.count(dbl(c)))]
    n, *found = aggregate(df, [F.count(F.lit(1)), *parts])
    means = {c: found[2 * k] or 0.0 for k, c in enumerate(columns)}
    return n, means, {c for k, c in enumerate(columns) if found[2 * k + 1] < n}


def pair_correlations(
    df: DataFrame,
    columns: Sequence[str],
    pairs: Sequence[Pair] | None = None,
    summed_columns: int | None = None,
) -> dict[Pair, float | None]:
    """r of every pair i <= j (or of the given pairs) over the rows where both are present.

    Two scans: the means, then sums of centred products. Sums are the cheapest aggregates
    Spark compiles; columns without gaps share their single-column sums between all pairs.
    """
    if pairs is None:
        if len(columns) > (SUMMED_COLUMNS if summed_columns is None else summed_columns):
            return _blocked(df, columns)
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    n, means, gaps = _centres(df, columns)
    place = {c: f"c{k}" for k, c in enumerate(columns)}
    centred = df.select(*[(dbl(c) - F.lit(means[c])).alias(k) for c, k in place.items()])
    terms: dict[tuple, Column] = {}
    for a, b in pairs:
        x, y = F.col(place[a]), F.col(place[b])
        if a in gaps or b in gaps:
            both = x.isNotNull() & y.isNotNull()
            parts = (F.lit(1), x, y, x * x, y * y, x * y)
            for k, part in enumerate(parts):
                terms[a, b, k] = F.sum(F.when(both, part))
            continue
        for c, v in ((a, x), (b, y)):
            terms[c,] = F.sum(v)
            terms[c, c] = F.sum(v * v)
        terms[a, b] = F.sum(x * y)
    found = aggregate(centred, list(terms.values()))
    sums: dict[tuple, float] = {key: v or 0.0 for key, v in zip(terms, found)}
    out = {}
    for a, b in pairs:
        if a in gaps or b in gaps:
            out[a, b] = _coefficient(*[sums[a, b, k] for k in range(6)])
        else:
            out[a, b] = _coefficient(n, sums[a,], sums[b,], sums[a, a], sums[b, b], sums[a, b])
    return out


def _blocked(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Many columns: each task sums its own masked cross products, one p x p block per batch of rows.

    Values are centred on the column means first, so the sums keep their digits.
    """
    p = len(columns)
    _, means, _ = _centres(df, columns)
    shift = np.array([means[c] for c in columns])
    upper = np.triu_indices(p)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((5, p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            sums[0] += m.T @ m
            sums[1] += x.T @ m
            sums[2] += (x * x).T @ m
            sums[3] += x.T @ x
            sums[4] += m.T @ x
        i, j = upper
        yield pd.DataFrame(
            {
                "i": i,
                "j": j,
                "n": sums[0][upper],
                "si": sums[1][upper],
                "sj": sums[4][upper],
                "sii": sums[2][upper],
                "sjj": sums[2].T[upper],
                "sij": sums[3][upper],
            }
        )

    values = df.select(*[dbl(c).alias(f"c{i}") for i, c in enumerate(columns)])
    fields = "i int, j int, n double, si double, sj double, sii double, sjj double, sij double"
    total = (
        values.mapInPandas(blocks, fields)
        .groupBy("i", "j")
        .agg(*[F.sum(k).alias(k) for k in ("n", "si", "sj", "sii", "sjj", "sij")])
        .collect()
    )
    return {
        (columns[r["i"]], columns[r["j"]]): _coefficient(*[r[k] for k in ("n", "si", "sj", "sii", "sjj", "sij")])
        for r in total
    }


def _matrix_frame(df: DataFrame, columns: Sequence[str], r: dict, digits: int | None) -> DataFrame:
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            rows.append((a, b, i, j, r.get((a, b), r.get((b, a)))))
    frame = local_frame(df.sparkSession, rows, "col_a string, col_b string, i int, j int, r double")
    return frame if digits is None else frame.withColumn("r", F.round("r", digits))


def corr_pearson(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    digits: int | None = 2,
    summed_columns: int | None = None,
) -> DataFrame:
    """The full matrix in long form: (col_a, col_b, i, j, r).

    Beyond ``summed_columns`` the cross products are summed in blocks.
    """
    columns = list(columns or numeric_columns(df))
    return _matrix_frame(df, columns, pair_correlations(df, columns, summed_columns=summed_columns), digits)


def corr_lower_triangle(matrix: DataFrame) -> DataFrame:
    """Diagonal and below."""
    return matrix.where(F.col("i") >= F.col("j"))


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """One coefficient for a drill-down."""
    return df.agg(F.round(pearson(dbl(a), dbl(b)), 4).alias("r")).select(
        F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "r"
    )


def target_corr(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """|r| of every numeric column with the target, weakest first, with a strength band."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    found = pair_correlations(df, [*columns, target], [(c, target) for c in columns])
    strengths = [(c, None if r is None else abs(r)) for (c, _), r in found.items()]
    frame = local_frame(df.sparkSession, strengths, "column string, abs_r double")
    band = F.when(F.col("abs_r") >= 0.5, "strong").when(F.col("abs_r") >= 0.2, "moderate").otherwise("weak")
    return (
        frame.where(F.col("abs_r").isNotNull())
        .withColumn("band", band)
        .withColumn("abs_r", F.round("abs_r", 4))
        .orderBy("abs_r", "column")
    )


def average_ranks(long: DataFrame) -> DataFrame:
    """(which, value, rank) per distinct value of each of several rankings, ties sharing their average rank.

    ``long`` has (which, value). Ranks come from the value counts of all rankings in one
    ordered table, so a value held by a third of the rows is one row, and there is one sort.
    """
    counts = long.groupBy("which", "value").agg(F.count(F.lit(1)).alias("cnt"))
    placed = running_weights(counts, [F.col("value")], {"cnt": "upto"}, keys=["which"])
    rank = F.col("upto") - F.col("cnt") + (F.col("cnt") + 1) / 2
    return placed.select("which", "value", rank.cast("double").alias("rank"))


def _packed(numbers: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes: what small ones have in common takes no room."""
    planes = np.ascontiguousarray(numbers).reshape(-1, 1).view(np.uint8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _steps(ascending: np.ndarray) -> bytes:
    """Lists of ascending numbers by their differences, which may run over and back."""
    return _packed(np.diff(ascending, axis=-1, prepend=np.int64(0)))


def _climbed(data: bytes, n: int, lists: int = 1) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<i8", n * lists).reshape(lists, n), axis=1)


def _sortable(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _blocks(p: int, size: int, every: int):
    """Rows in blocks of ``size``, a row per block and column: its distinct values with how many rows of each have the
    other columns, and the place of each row's value among them. One value in ``every`` is a sample."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, have = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - have))
                batch, have = batch.slice(held[-1].num_rows), have + held[-1].num_rows
                if have == size:
                    yield pa.Table.from_batches(held)
                    held, have = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for block, rows in enumerate(cut(batches), first):
            columns = [c.combine_chunks() for c in rows.columns]
            there = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
            for c, column in enumerate(columns):
                keys, codes = np.unique(_sortable(column.drop_null().to_numpy()), return_inverse=True)
                if not len(keys):
                    continue
                counts = np.stack([np.bincount(codes[seen[there[c]]], minlength=len(keys)) for seen in there])
                some = keys[np.random.default_rng([block, c]).integers(every) :: every]
                cells = (
                    block, c, rows.num_rows, len(keys), _steps(keys), _packed(counts.astype(np.int32)),
                    np.packbits(there[c]).tobytes(), _packed(codes.astype(np.int32)), some.tolist(),
                )
                yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, cells))], schema=BLOCKS)

    return run


def _values(batch: pa.RecordBatch, p: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, c, values, counts by partner) of each row."""
    for row in batch.select(["block", "c", "d", "keys", "counts"]).to_pylist():
        d = row["d"]
        counts = _unpacked(row["counts"], "<i4", d * p).reshape(p, d)
        yield row["block"], row["c"], _climbed(row["keys"], d)[0], counts


def _edges(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where the ranges of ascending values begin, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def _totals(p: int, cuts: dict[int, np.ndarray]):
    """How many rows of a task have a value in each range of a column, and each other column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {c: np.zeros((p, len(bounds) + 1), np.int64) for c, bounds in cuts.items()}
        for batch in batches:
            for _, c, keys, counts in _values(batch, p):
                upto = np.zeros((p, len(keys) + 1), np.int64)
                np.cumsum(counts, axis=1, out=upto[:, 1:])
                found[c] += np.diff(upto[:, _edges(keys, cuts[c])], axis=1)
        for c, counts in found.items():
            j, r = np.nonzero(counts)
            columns = (np.full(len(j), c, np.int32), r.astype(np.int32), j.astype(np.int32), counts[j, r])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c", "r", "j", "n"])

    return run


def _requests(p: int, cuts: dict[int, np.ndarray]):
    """A block's values by the range that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, c, keys, counts in _values(batch, p):
                at, out = _edges(keys, cuts[c]), []
                for r in np.flatnonzero(np.diff(at)).tolist():
                    a, b = at[r], at[r + 1]
                    out.append((c, r, block, int(b - a), _steps(keys[a:b]), _packed(counts[:, a:b])))
                yield pa.RecordBatch.from_pylist([dict(zip(REQUESTS.names, x)) for x in out], schema=REQUESTS)

    return run


def _answers(p: int, below: dict[int, np.ndarray]):
    """Twice the ranks of the values of a range, one for every partner, for each block that asked."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        c, r = rows[0]["c"], rows[0]["r"]
        keys = np.concatenate([_climbed(x["keys"], x["d"])[0] for x in rows])
        held = np.concatenate([_unpacked(x["counts"], "<i4", x["d"] * p).reshape(p, -1) for x in rows], axis=1)
        found, place = np.unique(keys, return_inverse=True)
        twice = np.empty((p, len(found)), np.int64)
        for j in range(p):
            counts = np.bincount(place, weights=held[j], minlength=len(found)).astype(np.int64)
            twice[j] = 2 * (below[c][j, r] + np.cumsum(counts)) - counts + 1
        out, at = [], 0
        for x in rows:
            ranks = twice[:, place[at : at + x["d"]]]
            out.append((x["block"], c, r, x["d"], _steps(ranks)))
            at += x["d"]
        return pa.Table.from_pylist([dict(zip(ANSWERS.names, x)) for x in out], schema=ANSWERS)

    return run


def _ranked(blocks: DataFrame, p: int, cuts: dict, below: dict, pieces: int) -> DataFrame:
    """(block, c, r, d, ranks): the ranks of a block's distinct values, range by range.

    A value is one entry for each block that has it, however many rows hold it, so no task has all rows of a value.
    """
    asked = blocks.select("block", "c", "d", "keys", "counts").mapInArrow(_requests(p, cuts), REQUESTS_DDL)
    owners = max(pieces, sum(len(bounds) + 1 for bounds in cuts.values()))
    found = asked.repartition(owners, "c", "r").groupBy("c", "r").applyInArrow(_answers(p, below), ANSWERS_DDL)
    return found.repartition(pieces, "block")


def _pair_sums(p: int):
    """Sums over the rows of a block for all pairs, from the places of its values and their ranks."""
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        there, codes, parts = {}, {}, {}
        for row in block.to_pylist():
            c, n = row["c"], row["n"]
            there[c] = np.unpackbits(np.frombuffer(row["seen"], np.uint8), count=n).astype(bool)
            codes[c] = np.zeros(n, np.int32)
            codes[c][there[c]] = _unpacked(row["codes"], "<i4", int(there[c].sum()))
        for row in sorted(answers.to_pylist(), key=lambda x: (x["c"], x["r"])):
            parts.setdefault(row["c"], []).append(_climbed(row["ranks"], row["d"], p))
        ranks = {c: np.concatenate(found, axis=1) / 2 for c, found in parts.items()}
        sums = np.zeros((6, len(pairs)))
        for k, (i, j) in enumerate(pairs):
            if i in there and j in there:
                both = there[i] & there[j]
                x, y = ranks[i][j][codes[i][both]], ranks[j][i][codes[j][both]]
                sums[:, k] = len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
        columns = [pa.array(np.array([q[e] for q in pairs], np.int32)) for e in (0, 1)] + [pa.array(s) for s in sums]
        return pa.Table.from_arrays(columns, names=["i", "j", *SUMS])

    return run


def _spearman_with_gaps(clean: DataFrame, columns: Sequence[str]) -> dict[Pair, float | None]:
    """r of every pair i < j, each ranked on its own complete rows.

    Rows are written in packed blocks, once. A block sends its distinct values to the owners of ranges of each column,
    which add up how many rows every partner has below a value and send the ranks back, one for every partner.
    So the lists that travel are sorted and small beside the rows, and no rows do but as places in such lists.
    """
    p, spark = len(columns), clean.sparkSession
    piece = max(1, min(PIECE, BLOCK_CELLS * 4 // p))
    path = scratch_path(spark, "ranked-blocks")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        packed = _blocks(p, max(1, min(RANK_ROWS, BLOCK_CELLS // p)), max(1, piece // FREQUENT))
        clean.mapInArrow(packed, BLOCKS_DDL).write.parquet(path)
        blocks = spark.read.schema(BLOCKS_DDL).parquet(path)
        cuts, many = {}, 0
        some = F.array_sort(F.flatten(F.collect_list("some"))).alias("some")
        for row in blocks.groupBy("c").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("n"), some).collect():
            ranges, found = -(-row["d"] // piece), np.array(row["some"], np.int64)
            cuts[row["c"]] = np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found
            many = max(many, row["n"])
        if not many:
            return {}
        below = {c: np.zeros((p, len(bounds) + 2), np.int64) for c, bounds in cuts.items()}
        counted = blocks.select("block", "c", "d", "keys", "counts").mapInArrow(_totals(p, cuts), "c int, r int, j int, n bigint")
        for row in counted.groupBy("c", "r", "j").agg(F.sum("n").alias("n")).collect():
            below[row["c"]][row["j"], row["r"] + 1] = row["n"]
        below = {c: np.cumsum(found, axis=1) for c, found in below.items()}
        pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // BLOCKS_A_TASK))
        ranked = _ranked(blocks, p, cuts, below, pieces)
        rows = blocks.select("block", "c", "n", "seen", "codes").repartition(pieces, "block")
        sums = rows.groupBy("block").cogroup(ranked.groupBy("block")).applyInArrow(
            _pair_sums(p), "i int, j int, " + ", ".join(f"{f} double" for f in SUMS)
        )
        total = sums.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in SUMS]).collect()
    finally:
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return {(columns[r["i"]], columns[r["j"]]): _coefficient(*[r[f] for f in SUMS]) for r in total}


def corr_spearman(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = 2) -> DataFrame:
    """Pearson on average ranks. A pair with gaps is ranked on its complete rows.

    Without gaps a column is ranked once, for all its pairs: one sort, one join and one grouping back to rows. With
    gaps it has a rank for every partner, from running totals over its distinct values, see ``_spearman_with_gaps``.
    """
    columns = list(columns or numeric_columns(df))
    clean = df.select(*[dbl(c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = aggregate(
        clean, [a for c in clean.columns for a in (F.count(F.when(F.col(c).isNull(), 1)), F.min(c), F.max(c))]
    )
    varies = {i for i in range(len(columns)) if found[3 * i + 1] != found[3 * i + 2]}
    r: dict[Pair, float | None] = {(c, c): 1.0 if i in varies else None for i, c in enumerate(columns)}
    if len(columns) < 2:
        return _matrix_frame(df, columns, r, digits)
    if any(found[3 * i] for i in range(len(columns))):
        return _matrix_frame(df, columns, r | _spearman_with_gaps(clean, columns), digits)
    names = clean.columns
    wide = clean.select(F.monotonically_increasing_id().alias("__row"), *names)
    long = wide.unpivot(["__row"], [F.col(c) for c in names], "which", "value")
    there = average_ranks(long).select(F.col("which").alias("__w"), F.col("value").alias("__v"), "rank")
    ranked = long.join(sized(there), (F.col("which") == F.col("__w")) & (F.col("value") == F.col("__v")))
    back = ranked.groupBy("__row").agg(*[F.max(F.when(F.col("which") == c, F.col("rank"))).alias(c) for c in names])
    wanted = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    for (a, b), v in pair_correlations(checkpoint(back), names, wanted).items():
        r[columns[int(a[1:])], columns[int(b[1:])]] = v
    return _matrix_frame(df, columns, r, digits)
