"""Embedding whitening by singular values, without forming the covariance.

Rows are centred and reduced by blockwise QR: a task folds its rows, block after block, into one
triangular factor, and the tasks' factors are folded in groups until one is left. That factor
R, of the size of the dimensions alone, is made bidiagonal by Householder reflections from both
sides; dqds finds the squared singular values to full relative accuracy; a twisted factorisation
at each of the wanted values gives its vector, turned back by the right-hand reflections.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.session import checkpoint

BLOCK_ROWS = 1 << 12
FOLD = 16  # triangular factors that one task folds into one
SAFE = 1 << 62
EPS = np.finfo(float).eps
TINY = 1e-40  # of the largest squared entry: what stands for zero in dqds
MAX_STEPS = 400  # of dqds for one value; a few are usual


def fixed_point(embedding: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of every entry as long; null if one is null, not finite or beyond a long."""
    whole = F.transform(embedding, lambda c: c.cast("double"))
    limit = F.lit(float(2**62) / scale)
    bad = F.exists(whole, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= limit))
    return F.when(
        embedding.isNotNull() & ~bad, F.transform(whole, lambda c: F.floor(c * scale).cast("bigint") + F.lit(shift))
    )


# On rows, inside tasks.


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ``BLOCK_ROWS`` rows beside their vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            lists = part[column]
            ends = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64)
            yield part, values.reshape(part.num_rows, -1)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they hold it, else as Python integers."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most < SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(float)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its rows and, per dimension, the sums of the upper and of the lower 32 bits."""
    for part, x in _blocks(batches):
        high, low = x >> 32, x & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.num_rows]), pa.array([high.sum(axis=0).tolist()]), pa.array([low.sum(axis=0).tolist()])],
            names=["n", "high", "low"],
        )


def fold(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of what ``r`` stands for and of ``rows`` together."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _factor(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches):
            r = fold(r, _centred(x, n, sums))
        if r is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"]
            )

    return run


def _folded(dimensions: int):
    def run(table: pa.Table) -> pa.Table:
        r = None
        for blob in table.sort_by("part")["r"]:
            r = fold(r, np.frombuffer(blob.as_buffer(), float).reshape(-1, dimensions))
        part = min(table["part"].to_pylist()) // FOLD
        return pa.table({"part": pa.array([part], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def triangular(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of the centred rows: blocks within tasks, then factors in groups of ``FOLD``."""
    d = len(sums)
    factors = checkpoint(rows.mapInArrow(_factor(n, sums), "part bigint, r binary"))
    groups = factors.agg(F.max("part")).first()[0] + 1
    while groups > 1:
        group = F.floor(F.col("part") / FOLD).cast("bigint").alias("group")
        factors = factors.groupBy(group).applyInArrow(_folded(d), "part bigint, r binary")
        groups = -(-groups // FOLD)
    r = np.frombuffer(bytes(factors.first()["r"]), float).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])[:d]


# On matrices of the size of the dimensions.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, with R = U B V': Householder reflections from both sides."""
    a = r.astype(float).copy()
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """The unit vector u for which x - 2 u (u'x) has only a first entry; None if it has no other already."""
        scale = np.abs(x).max(initial=0.0)
        if scale == 0 or not x[1:].any():
            return None
        u = x / scale
        u[0] += math.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(n):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < n:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd transform; None if the shift lies above the smallest value."""
    d, ds, q2, e2 = q[0] - shift, [], [], []
    for k in range(len(q) - 1):
        if d < 0:
            return None
        ds.append(d)
        top = d + e[k]
        t = q[k + 1] / top if top > 0 else 0.0
        q2.append(top)
        e2.append(e[k] * t)
        d = d * t - shift if top > 0 else q[k + 1] - shift
    if not d >= 0:
        return None
    ds.append(d)
    q2.append(d)
    return q2, e2, ds


def _negligible(q: list[float], e: list[float], k: int, shifted: float) -> bool:
    """Whether no value changes in double precision if e[k] becomes zero."""
    return e[k] <= EPS * EPS * (shifted + q[k + 1]) or e[k] + math.sqrt(q[k] * e[k]) <= EPS * shifted / 4


def _discs(q: list[float], e: list[float]) -> float:
    """A bound below the smallest value: Gershgorin's discs of the tridiagonal product."""
    least, before, over = math.inf, 0.0, 0.0
    for k in range(len(q)):
        beside = math.sqrt(q[k] * e[k]) if k < len(e) else 0.0
        least = min(least, q[k] + over - before - beside)
        before, over = beside, e[k] if k < len(e) else 0.0
    return least * (1 - 1e-12)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, falling: the dqds algorithm.

    A shift that the last transform proves to lie below the smallest value never fails; a bolder one
    from the last two rows is tried first. A negligible superdiagonal entry splits the matrix.
    """
    biggest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if biggest == 0:
        return np.zeros(len(diagonal))
    floor = TINY
    q = [max(float(x / biggest) ** 2, floor) for x in diagonal]
    e = [float(x / biggest) ** 2 for x in above]
    if q[0] < q[-1]:  # large values first: the transform pushes small ones to the end
        q, e = _flipped(q, e)
    todo, values, steps = [(q, e, 0.0, 0.0)], [], 0
    while todo:
        q, e, shifted, safe = todo.pop()
        if len(q) == 1:
            values.append(shifted + q[0])
            steps = 0
            continue
        cut = next((k for k in range(len(e) - 1, -1, -1) if _negligible(q, e, k, shifted)), None)
        if cut is not None:
            todo += [(q[: cut + 1], e[:cut], shifted, 0.0), (q[cut + 1 :], e[cut + 1 :], shifted, 0.0)]
            continue
        steps += 1
        if steps > MAX_STEPS * 8:
            raise ArithmeticError("dqds did not converge")
        # the smaller value of the last two rows, less what the next row may add
        a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        low = (a + b) / 2 - math.hypot((a - b) / 2, math.sqrt(c))
        safe = max(safe, _discs(q, e))
        bold = max(safe, low * (1 - min(0.5, math.sqrt(e[-1] / (q[-1] + e[-1])))))
        took = _step(q, e, bold) if steps <= MAX_STEPS else None
        shift = bold
        if took is None:
            shift = safe
            took = _step(q, e, shift)
        if took is None:
            shift = 0.0
            took = _step(q, e, shift)
        q, e, ds = took
        least = min(ds)
        # 1 / ds are the diagonal of an inverse: their sum bounds the smallest value from below
        bound = 0.0 if least <= 0 or shift else (1 - 1e-12) / sum(1 / d for d in ds)
        todo.append((q, e, shifted + shift, bound))
    return np.array(sorted(values, reverse=True)) * biggest**2


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same matrix read from the other end."""
    d, q2, e2 = q[-1], [], []
    for k in range(len(e) - 1, -1, -1):
        # B' from the other end: the transform of a reversed bidiagonal has the reversed entries
        q2.append(d)
        e2.append(e[k])
        d = q[k]
    return [*q2, d], e2


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit eigenvector of B'B at ``value``, orthogonal to ``others``, from twisted factorisations.

    The stationary transform from the top and the progressive one from the bottom meet at row k with
    the remainder gamma; the row of the smallest remainder gives the vector. Where values lie close together
    that vector may repeat an earlier one; then the row of the next remainder is taken.
    """
    n = len(diagonal)
    a2, b2, ab = diagonal**2, above**2, diagonal[:-1] * above
    tiny = max(value, a2.max(), b2.max(initial=0.0)) * EPS * EPS or 1.0
    solid = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        top = solid(s[i] + a2[i])
        down[i] = ab[i] / top
        s[i + 1] = b2[i] / top * s[i] - value
    p[-1] = a2[-1] - value
    for i in range(n - 2, -1, -1):
        low = solid(b2[i] + p[i + 1])
        up[i] = ab[i] / low
        p[i] = p[i + 1] * (a2[i] / low) - value
    best = None
    for k in np.argsort(np.abs(s + p + value), kind="stable"):
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = np.abs(z).max()
        if not np.isfinite(size):
            continue
        z = z / size
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in others:
                z = z - (other @ z) * other
        left = float(np.linalg.norm(z))
        if best is None or left > best[0]:
            best = (left, z / left if left else z)
        if left > 0.5:
            break
    if best is None or best[0] < 1e-8:
        raise ArithmeticError("no vector apart from the others")
    return best[1]


def principal(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of R'R / n and their unit vectors as columns."""
    d = r.shape[1]
    k = min(k, d)
    diagonal, above, v = bidiagonal(r)
    # what rounding has left off the diagonal couples nothing: without it, equal values lie in blocks of their own
    biggest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    above = np.where(np.abs(above) <= 8 * EPS * biggest, 0.0, above)
    values = squared_singular_values(diagonal, above)[:k]
    found: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [z for z, w in zip(found, values[:i]) if w - value <= 1e-3 * w]
        if value <= EPS * d * values[0]:  # no direction of its own: any one of what is left
            near = found
        found.append(twisted(diagonal, above, float(value), near))
    return values / n, v @ np.array(found).reshape(k, d).T


def _shares(n: int, sums: list[int], turn: np.ndarray):
    """Per task: how many rows, the sums of the whitened values and of their products."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, second = 0, np.zeros(k), np.zeros((k, k))
        for part, x in _blocks(batches):
            w = _centred(x, n, sums) @ turn
            total += part.num_rows
            first += w.sum(axis=0)
            second += w.T @ w
        values = np.concatenate([first, second.ravel()])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["at", "value"])

    return run


def _whiten(n: int, sums: list[int], turn: np.ndarray, real: np.ndarray):
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            away = _deviations(x, n, sums)
            most = float(np.abs(away.astype(float)).max(initial=0))
            wide = away.astype(object) if most * most * max(1, x.shape[1]) >= SAFE else away
            far = [min(int(v), 2**63 - 1) for v in (wide * wide).sum(axis=1)] if x.shape[1] else [0] * len(x)
            w = (away / n).astype(float) @ turn
            row = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part["vec_id"].take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(far, pa.int64()).take(pa.array(row)),
                    pa.array(w.ravel(), mask=np.tile(~real, len(x))),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return run


def whiten(
    df: DataFrame,
    components: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """Whitened principal components of the vectors: one row per vector and component.

    Entries become x = floor(scale * c) + shift. Returns vec_id, component (from 1, by falling eigenvalue
    of x's covariance with divisor n), n, deviation (sum over dimensions of (n*x - S)^2, exact; the
    largest long if it does not fit), whitened, explained (the eigenvalue's share of the trace) and
    identity_error (largest absolute entry of whitened's covariance less the identity).

    A vector that is null, holds null or non-finite entries or entries beyond 62 bits, or is shorter
    than the longest takes no part. Fewer dimensions than ``components`` give that many. A direction without
    variance (by double precision of the largest) has whitened null and explained 0 and is left out of
    identity_error, which is null without any. Rows that repeat an id each count, a null id stays null; other
    columns are ignored. A table without vectors gives an empty result. Reads the table five times.
    """
    spark = df.sparkSession
    empty = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), fixed_point(F.col(f"`{vector_col}`"), scale, shift).alias("x")
    ).where("x is not null")
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("x") == d)
    parts = rows.select("x").mapInArrow(_sums, "n bigint, high array<bigint>, low array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    per = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "part"))
    per = per.groupBy("at").agg(F.sum("n").alias("n"), exact("part.high"), exact("part.low")).collect()
    per.sort(key=lambda r: r["at"])
    n = per[0]["n"]
    sums = [(int(r["part.high"]) << 32) + int(r["part.low"]) for r in per]

    r = triangular(rows.select("x"), n, sums)
    values, vectors = principal(r, n, components)
    trace = float((r * r).sum()) / n
    real = values > EPS * d * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    turn = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)

    k = len(values)
    shares = rows.select("x").mapInArrow(_shares(n, sums, turn), "at bigint, value double")
    found = {s["at"]: s["value"] for s in shares.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    totals = np.array([found[i] for i in range(k + k * k)])
    mean, second = totals[:k] / n, totals[k:].reshape(k, k) / n
    off = np.abs(second - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if off.size else None

    explained = [float(v) / trace if u else 0.0 for v, u in zip(values, real)]
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    out = rows.mapInArrow(_whiten(n, sums, turn, real), "vec_id bigint, component int, deviation bigint, whitened double")
    return out.select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
