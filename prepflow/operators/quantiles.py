"""Exact quantiles with linear interpolation, without gathering a column in one task.

1. a mergeable sketch of all rows, which comes with the row count, proposes a narrow value bracket
   around every wanted position;
2. one scan counts, exactly, the rows below and inside each bracket;
3. one scan gathers only the rows inside the brackets and picks the wanted positions.

Step 2 proves the bracket right. A bracket that misses its position is replaced by the
whole value range, so the answer is exact whatever the sketch said.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.functions.columns import aggregate, chunks, col, dbl, local_frame, num, sized
from prepflow.functions.moments import fences, interpolate
from prepflow.operators.ordering import running_weights
from prepflow.session import together

ACCURACY = 10_000
SLACK = 3 / ACCURACY  # a sketch's ranks are off by one part in ACCURACY at most

Columns = Mapping[str, Column]


@dataclass(frozen=True)
class Plan:
    """Where one way to the same answer gives over to the next.

    Up to ``builtin_cells`` the built-in exact percentile holds all cells in one small buffer;
    above ``window_rows`` gathered rows positions come from a range-partitioned running total.
    """

    builtin_cells: int = 1_000_000
    window_rows: int = 2_000_000


PLAN = Plan()


def clean_value(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def exact_quantiles(
    df: DataFrame,
    columns: Columns | Sequence[str],
    probs: Sequence[float],
    n_rows: int | None = None,
    plan: Plan | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric expressions at once, on the driver: len(columns) x len(probs) numbers."""
    if not isinstance(columns, Mapping):
        columns = {n: num(n) for n in columns}
    plan = plan or PLAN
    columns = {n: clean_value(c) for n, c in columns.items()}
    if not columns:
        return {}
    groups = [dict(g) for g in chunks(list(columns.items()), 1 + 2 * len(probs))]

    def solve(part: Columns) -> dict:
        n, brackets = n_rows, None
        if n is None or n * len(part) > plan.builtin_cells:
            n, *found = df.agg(F.count(F.lit(1)), *sketches(part, probs)).first()
            brackets = brackets_of(part, probs, found)
        if n * len(part) <= plan.builtin_cells:
            return _builtin(df, part, probs)
        counted = list(df.agg(*bracket_counts(part, probs, brackets)).first())
        return gathered(df, part, probs, brackets, counted, plan)

    out: dict[str, list[float | None]] = {}
    for found in together(df.sparkSession, *[lambda g=g: solve(g) for g in groups]):
        out.update(found)
    return out


def _builtin(df: DataFrame, columns: Columns, probs: Sequence[float]) -> dict:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(*[F.percentile(c, wanted).alias(f"q{i}") for i, c in enumerate(columns.values())]).first()
    return {n: list(row[i]) if row[i] is not None else [None] * len(probs) for i, n in enumerate(columns)}


def sketches(columns: Columns, probs: Sequence[float]) -> list[Column]:
    """One aggregate per column: approximate values a little to both sides of every wanted position."""
    marks = [m for p in probs for m in (max(p - SLACK, 0.0), min(p + SLACK, 1.0))]
    return [F.percentile_approx(c, marks, ACCURACY) for c in columns.values()]


def brackets_of(columns: Columns, probs: Sequence[float], found: Sequence) -> dict:
    """Per column and probability the (low, high) value bracket that ``sketches`` give; None is an open end."""
    brackets = {}
    for n, values in zip(columns, found):
        for j, p in enumerate(probs):
            low = None if values is None or p - SLACK <= 0 else values[2 * j]
            high = None if values is None or p + SLACK >= 1 else values[2 * j + 1]
            brackets[n, j] = (low, high)
    return brackets


def _inside(c: Column, bracket) -> Column:
    low, high = bracket
    test = c.isNotNull()
    if low is not None:
        test = test & (c >= F.lit(low))
    if high is not None:
        test = test & (c <= F.lit(high))
    return test


def _below(c: Column, bracket) -> Column:
    return F.lit(False) if bracket[0] is None else c < F.lit(bracket[0])


def _count_if(test: Column) -> Column:
    return F.sum(F.when(test, F.lit(1)).otherwise(F.lit(0)))


def bracket_counts(columns: Columns, probs: Sequence[float], brackets: dict) -> list[Column]:
    """What proves the brackets, or not: per column its values, and those below and inside of each."""
    counted = []
    for n, c in columns.items():
        counted.append(F.count(c))
        for j in range(len(probs)):
            counted += [_count_if(_below(c, brackets[n, j])), _count_if(_inside(c, brackets[n, j]))]
    return counted


def gathered(df: DataFrame, columns: Columns, probs: Sequence[float], brackets: dict, row: Sequence, plan: Plan) -> dict:
    """The quantiles, from the values inside the brackets that ``row`` counts; one that is wrong becomes everything."""
    targets, at, rows = [], 0, 0
    out: dict[str, list] = {n: [None] * len(probs) for n in columns}
    for n in columns:
        size = row[at]
        at += 1
        for j, p in enumerate(probs):
            below, inside = row[at] or 0, row[at + 1] or 0
            at += 2
            if not size:
                continue
            position = (size - 1) * p
            first, last = math.floor(position), math.ceil(position)
            if not (below <= first and last < below + inside):
                brackets[n, j], below, inside = (None, None), 0, size
            low, high = brackets[n, j]
            if low is not None and low == high:  # one value covers the position: nothing to gather
                out[n][j] = low
                continue
            rows += inside
            targets.append((n, j, first - below, last - below, position - first))
    if not targets:
        return out
    picked = _pick(df, columns, brackets, targets, rows <= plan.window_rows)
    for k, (n, j, first, last, fraction) in enumerate(targets):
        out[n][j] = interpolate(picked[k, first], picked[k, last], fraction)
    return out


def _pick(df, columns, brackets, targets, few: bool) -> dict[tuple[int, int], float]:
    """The values at the wanted positions of every bracket."""
    labels = [str(k) for k in range(len(targets))]
    values = (
        df.select(
            *[
                F.when(_inside(columns[n], brackets[n, j]), columns[n]).alias(label)
                for label, (n, j, *_) in zip(labels, targets)
            ]
        )
        .unpivot([], [F.col(label) for label in labels], "target", "value")
        .where(F.col("value").isNotNull())
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    if few:
        upto = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        placed = values.withColumn("upto", F.sum("cnt").over(upto))
    else:
        placed = running_weights(values, [F.col("value")], {"cnt": "upto"}, keys=["target"])
    start = F.col("upto") - F.col("cnt")
    wanted = F.lit(False)
    for k, (_, _, first, last, _) in enumerate(targets):
        hit = F.lit(False)
        for position in {first, last}:
            hit = hit | ((start <= position) & (F.col("upto") > position))
        wanted = wanted | ((F.col("target") == labels[k]) & hit)
    found = placed.where(wanted).select("target", "value", start.alias("start"), "upto").collect()
    picked = {}
    for k, (_, _, first, last, _) in enumerate(targets):
        for r in found:
            if r["target"] != labels[k]:
                continue
            for position in (first, last):
                if r["start"] <= position < r["upto"]:
                    picked[k, position] = r["value"]
    return picked


def quantile_stats(df: DataFrame, names: Sequence[str], plan: Plan | None = None) -> DataFrame:
    """Quartiles per column."""
    found = exact_quantiles(df, names, [0.25, 0.5, 0.75], plan=plan)
    rows = [(n, *found[n]) for n in names]
    return local_frame(df.sparkSession, rows, "column string, q25 double, median double, q75 double")


def iqr_fences(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Outlier limits per column."""
    found = exact_quantiles(df, names, [0.25, 0.75])
    rows = [(n, *fences(*found[n])) for n in names]
    frame = local_frame(df.sparkSession, rows, "column string, iqr_lower double, iqr_upper double")
    return frame.select(
        "column", F.round("iqr_lower", 6).alias("iqr_lower"), F.round("iqr_upper", 6).alias("iqr_upper")
    )


def outlier_tally(
    df: DataFrame, limits: Mapping[str, tuple], columns: Columns | None = None, rows: bool = False
) -> dict[str, int] | tuple[int, dict[str, int]]:
    """Rows strictly outside the limits: one scan for all columns, which can count all ``rows`` as well."""
    columns = columns or {n: dbl(n) for n in limits}
    known = [n for n, (lo, _) in limits.items() if lo is not None]
    out = dict.fromkeys(limits, 0)
    total = [F.count(F.lit(1))] if rows else []
    found = aggregate(df, total + [_count_if((columns[n] < limits[n][0]) | (columns[n] > limits[n][1])) for n in known])
    out.update({n: int(v or 0) for n, v in zip(known, found[len(total) :])})
    return (found[0], out) if rows else out


def counted_quantiles(
    counts: DataFrame, by: Sequence[str], value: str, cnt: str, probs: Sequence[float]
) -> DataFrame:
    """Quantiles of a (by.., value, cnt) count table: one row per ``by``, columns ``q0..``.

    Positions come from running totals over range partitions of the distinct values, so a
    group or a value that holds most of the rows is no larger than any other.
    """
    by = list(by)
    placed = running_weights(counts, [F.col(value)], {cnt: "__upto"}, keys=by)
    sizes = placed.groupBy(*[col(k).alias(f"__g{i}") for i, k in enumerate(by)]).agg(
        F.max("__upto").alias("__size")
    )
    same = [col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(by)]
    joined = placed.join(sized(sizes), same)
    upto = F.col("__upto")
    start = upto - F.col(cnt)
    aggs = []
    for i, p in enumerate(probs):
        position = (F.col("__size") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        aggs += [
            F.max(F.when((start <= low) & (upto > low), F.col(value))).alias(f"lo{i}"),
            F.max(F.when((start <= high) & (upto > high), F.col(value))).alias(f"hi{i}"),
            F.max(position - low).alias(f"f{i}"),
        ]
    picked = joined.groupBy(*[col(k) for k in by]).agg(*aggs)
    return picked.select(
        *[col(k) for k in by],
        *[
            (F.col(f"lo{i}") * (1 - F.col(f"f{i}")) + F.col(f"hi{i}") * F.col(f"f{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def grouped_quantiles(df: DataFrame, group: str, name: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of ``name`` within every group: ``group`` plus one column ``q0..`` per probability."""
    counts = (
        df.where(clean_value(dbl(name)).isNotNull())
        .groupBy(col(group), dbl(name).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__cnt"))
    )
    return counted_quantiles(counts, [group], "__value", "__cnt", probs)
