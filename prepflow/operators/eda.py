"""The data behind exploratory charts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.functions.columns import BROADCAST_BYTES, aggregate, col, dbl, local_frame, nan_to_null, numeric_columns
from prepflow.functions.moments import fences
from prepflow.operators.correlation import pair_correlations
from prepflow.operators.frequency import value_counts
from prepflow.operators.profile import moments, null_counts
from prepflow.operators.quantiles import exact_quantiles, grouped_quantiles
from prepflow.operators.types import ColumnTypes
from prepflow.session import checkpoint
from prepflow.sources.tables import sample_rows

# fixed values
GRID_POINTS = 300
PAIR_COLUMNS = 6
COMPONENTS = 3
MOMENTS = 14  # of the values in a box of half a bandwidth
REACH = 9  # bandwidths; a kernel is below 1e-17 there
ROW_BYTES = 128  # of a group's figures, without its name


def bin_count(n: int) -> int:
    return min(50, max(10, math.isqrt(n)))


def histogram(df: DataFrame, name: str) -> DataFrame:
    """Equal-width bins over the range of the finite values, empty bins included.

    Infinite values have a row each, without a bin, if there are any.
    """
    given = dbl(name)
    value = F.when(F.abs(given) < F.lit(math.inf), given)
    n, low, high, below, above = df.agg(
        F.count(value), F.min(value), F.max(value), F.count_if(given == -math.inf), F.count_if(given == math.inf)
    ).first()
    schema = "bin bigint, lo double, hi double, count bigint"
    ends = [(None, v, v, k) for v, k in ((-math.inf, below), (math.inf, above)) if k]
    outside = local_frame(df.sparkSession, ends, schema)
    if not n:
        return outside
    bins = bin_count(n)
    width = (high - low) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(value.isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    full = edges.join(F.broadcast(counts), "bin", "left").fillna(0, ["count"]).select("bin", "lo", "hi", "count")
    return full.unionByName(outside) if ends else full


def _hermite(moments: Sequence[Column]) -> list[Column]:
    """Coefficients of the polynomial in t that, times exp(-t^2 / 2), is a box's sum of kernels.

    exp(-(t - u)^2 / 2) is exp(-t^2 / 2) times the sum of He_k(t) u^k / k!; summed over a box's values,
    the powers of u become its moments, and the terms are collected by powers of t.
    """
    found = []
    for j in range(len(moments)):
        terms = [
            moments[j + 2 * m] * F.lit((-1) ** m / (math.factorial(m) * math.factorial(j) * 2**m))
            for m in range((len(moments) - j + 1) // 2)
        ]
        found.append(reduce(Column.__add__, terms))
    return found


def _kernel_sums(rows: DataFrame) -> DataFrame:
    """Sums of Gaussian kernels at the grid points near the values: (g, point, total, low, high, scale).

    A fast Gauss transform. ``rows`` carry (g, v) and their group's grid limits, bandwidth and scale. Values fall
    into boxes of half a bandwidth, and a box keeps ``MOMENTS`` moments of the distances to its middle, sums that
    combine before the shuffle; so what is left of a group grows with its range in bandwidths, not with its
    rows. Grid points within ``REACH`` bandwidths of a box are evaluated from the moments, to 13 digits of the kernel.
    """
    width = F.col("h") / 2
    box = F.floor((F.col("v") - F.col("low")) / width).cast("bigint")
    placed = rows.withColumn("box", box)
    middle = F.col("low") + (F.col("box") + 0.5) * width
    placed = placed.select("g", "low", "high", "h", "scale", "box", ((F.col("v") - middle) / F.col("h")).alias("u"))
    powers = [F.lit(1.0)]
    for _ in range(MOMENTS - 1):
        powers.append(powers[-1] * F.col("u"))
    boxes = placed.groupBy("g", "low", "high", "h", "scale", "box").agg(
        *[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)]
    )
    coefficients = _hermite([F.col(f"m{k}") for k in range(MOMENTS)])
    step = (F.col("high") - F.col("low")) / (GRID_POINTS - 1)
    away = middle - F.col("low")
    first = F.greatest(F.ceil((away - REACH * F.col("h")) / step), F.lit(0))
    last = F.least(F.floor((away + REACH * F.col("h")) / step), F.lit(GRID_POINTS - 1))
    near = boxes.select(
        "g", "low", "high", "h", "scale", away.alias("away"), step.alias("step"),
        *[c.alias(f"a{j}") for j, c in enumerate(coefficients)],
        F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).alias("points"),
    )
    near = near.withColumn("point", F.explode("points"))
    t = (F.col("point") * F.col("step") - F.col("away")) / F.col("h")
    near = near.withColumn("t", t)
    value = F.col(f"a{MOMENTS - 1}")
    for j in range(MOMENTS - 2, -1, -1):
        value = value * F.col("t") + F.col(f"a{j}")
    return near.select("g", "point", (F.exp(F.col("t") * F.col("t") * -0.5) * value).alias("total"), "low", "high", "scale")


def _densities(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(g, point, x, y): kernel density of the (g, v) rows, scaled to the histogram's counts.

    ``stats`` has one row per group: g, count, std, min, max. A group without finite spread has no density.
    """
    bins = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt(F.col("count").cast("double")))))
    h = F.pow(F.col("count").cast("double"), F.lit(-0.2)) * F.col("std")
    spread = (F.col("std") > 0) & (F.col("std") < math.inf) & (F.col("max") - F.col("min") < math.inf)
    shapes = stats.where((F.col("count") > 1) & spread & (F.col("max") > F.col("min"))).select(
        F.col("g").alias("sg"),
        F.col("min").alias("low"),
        F.col("max").alias("high"),
        h.alias("h"),
        ((F.col("max") - F.col("min")) / bins / (h * math.sqrt(2 * math.pi))).alias("scale"),
    )
    sums = _kernel_sums(rows.join(_measured(shapes, "sg"), F.col("g") == F.col("sg")).select("g", "v", "low", "high", "h", "scale"))
    # every point of every grid, also those that no value is near
    points = F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("point")
    empty = shapes.select(F.col("sg").alias("g"), points, F.lit(0.0).alias("total"), "low", "high", "scale")
    step = (F.col("high") - F.col("low")) / (GRID_POINTS - 1)
    summed = sums.unionByName(empty).groupBy("g", "point", "low", "high", "scale").agg(F.sum("total").alias("total"))
    return summed.select(
        "g",
        F.col("point").cast("bigint").alias("point"),
        (F.col("low") + F.col("point") * step).alias("x"),
        (F.col("total") * F.col("scale")).alias("y"),
    )


def _measured(groups: DataFrame, name: str) -> DataFrame:
    """One row per group, marked for broadcast if a count finds them small enough. ``groups`` is cheap to read."""
    n, text = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length(name))).first()
    return F.broadcast(groups) if n * ROW_BYTES + (text or 0) <= BROADCAST_BYTES else groups


def kde(df: DataFrame, name: str) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on 300 points from minimum to maximum."""
    m = moments(df, [name])[name]
    row = ("", m["count"], m["std"], m["min"], m["max"])
    stats = local_frame(df.sparkSession, [row], "g string, count bigint, std double, min double, max double")
    rows = df.select(F.lit("").alias("g"), dbl(name).alias("v")).where(F.col("v").isNotNull())
    return _densities(rows, stats).drop("g")


def _box(df: DataFrame, name: str) -> dict:
    q1, median, q3 = exact_quantiles(df, [name], [0.25, 0.5, 0.75])[name]
    low, high = fences(q1, q3)
    value = dbl(name)
    if low is None:
        return dict.fromkeys(("q1", "median", "q3", "lower", "upper", "whisker_low", "whisker_high", "mean")) | {
            "outliers": 0
        }
    inside = (value >= low) & (value <= high)
    row = df.agg(
        F.min(F.when(inside, value)),
        F.max(F.when(inside, value)),
        F.count(F.when(~inside, 1)),
        F.avg(value),
    ).first()
    return {
        "q1": q1, "median": median, "q3": q3, "lower": low, "upper": high,
        "whisker_low": row[0], "whisker_high": row[1], "outliers": int(row[2]), "mean": row[3],
    }


def box_stats(df: DataFrame, name: str) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and the number of outliers."""
    b = _box(df, name)
    keys = ("q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    schema = "q1 double, median double, q3 double, whisker_low double, whisker_high double, outliers bigint"
    return local_frame(df.sparkSession, [[b[k] for k in keys]], schema)


def box_outliers(df: DataFrame, name: str) -> DataFrame:
    """Every value outside the fences with its count."""
    low, high = fences(*exact_quantiles(df, [name], [0.25, 0.75])[name])
    if low is None:
        return value_counts(df, name)
    return value_counts(df.where((dbl(name) < low) | (dbl(name) > high)), name)


def violin_stats(df: DataFrame, name: str) -> DataFrame:
    """(part, label, x, y): the density curve, then box, mean and outlier limits."""
    b = _box(df, name)
    labels = ("q1", "median", "q3", "mean", "lower", "upper", "whisker_low", "whisker_high")
    summary = local_frame(
        df.sparkSession,
        [("summary", k, b[k], None) for k in labels],
        "part string, label string, x double, y double",
    )
    curve = kde(df, name).select(F.lit("density").alias("part"), F.col("point").cast("string").alias("label"), "x", "y")
    return summary.unionByName(curve)


def grouped_violin(df: DataFrame, name: str, group: str) -> DataFrame:
    """(group, part, label, x, y): density curve, quartiles and mean of every group."""
    rows = df.select(col(group).cast("string").alias("g"), dbl(name).alias("v")).where(
        F.col("g").isNotNull() & F.col("v").isNotNull()
    )
    stats = rows.groupBy("g").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    stats = checkpoint(stats)  # a row per group, read for the grids, the curves and the means
    curve = _densities(rows, stats).select(
        F.col("g").alias("group"), F.lit("density").alias("part"), F.col("point").cast("string").alias("label"), "x", "y"
    )
    quartiles = grouped_quantiles(rows, "g", "v", [0.25, 0.5, 0.75]).toDF("group", "q1", "median", "q3")
    means = stats.select(F.col("g").alias("group"), "mean")
    nothing = F.lit(None).cast("double").alias("y")
    summary = [
        frame.unpivot("group", labels, "label", "x").select("group", F.lit("summary").alias("part"), "label", "x", nothing)
        for frame, labels in ((quartiles, ["q1", "median", "q3"]), (means, ["mean"]))
    ]
    return curve.unionByName(summary[0]).unionByName(summary[1])


def category_bars(df: DataFrame, name: str, top_n: int = 15) -> DataFrame:
    """The most frequent values with their share of all rows."""
    n = df.count()
    top = value_counts(df, name).orderBy(F.desc("count"), F.asc("value")).limit(top_n)
    return top.select(
        F.col("value").cast("string").alias("value"),
        "count",
        F.round(F.col("count") / F.lit(max(n, 1)) * 100, 1).alias("pct"),
    )


def missing_bars(df: DataFrame) -> DataFrame:
    """Columns with nulls, worst first, banded at 5 and 20 percent."""
    n = F.col("null_pct")
    band = F.when(n < 5, "low").when(n < 20, "medium").otherwise("high")
    return (
        null_counts(df)
        .where(F.col("null_count") > 0)
        .select("column", "null_pct", band.alias("band"))
        .orderBy(F.desc("null_pct"), "column")
    )


def _points(
    df: DataFrame, columns: Sequence[str], complete: Sequence[str], max_points: int | None, keys: Sequence[str]
) -> DataFrame:
    """Complete rows; with ``max_points`` a reproducible sample ordered by the hash of ``keys``."""
    names = list(dict.fromkeys(columns))
    extra = [k for k in keys if k not in names]
    rows = nan_to_null(df.select(*[col(c) for c in names + extra])).dropna(subset=list(dict.fromkeys(complete)))
    if max_points is not None:
        rows = sample_rows(rows, keys, max_points)
    return rows.select(*[col(c) for c in names])


def scatter_points(df, x, y, color=None, max_points=None, keys=()) -> DataFrame:
    """(x, y[, color]) of every row with both values."""
    return _points(df, [x, y, *([color] if color else [])], [x, y], max_points, keys)


def scatter_matrix(df, columns: Sequence[str], color=None, max_points=None, keys=()) -> DataFrame:
    """Rows complete on all chosen columns and the colour."""
    chosen = [*columns, *([color] if color else [])]
    return _points(df, chosen, chosen, max_points, keys)


def pair_points(df, types: ColumnTypes, target=None, max_points=None, keys=()) -> DataFrame:
    """The first six numeric columns of every complete row, the target attached."""
    chosen = list(types.numeric[:PAIR_COLUMNS])
    if len(chosen) < 2:
        raise ValueError("need at least 2 numeric columns")
    return _points(df, [*chosen, *([target] if target else [])], chosen, max_points, keys)


def scatter_3d(df, x, y, z, color=None, size=None, max_points=None, keys=()) -> DataFrame:
    """(x, y, z[, color][, size]) of every complete row."""
    chosen = [x, y, z, *[c for c in (color, size) if c]]
    return _points(df, chosen, chosen, max_points, keys)


def hierarchy_rollup(df: DataFrame, path: Sequence[str], value: str | None = None) -> DataFrame:
    """Count, or sum of ``value``, for every prefix of ``path``; ``level`` is the prefix length.

    The full path is aggregated first, so the roll-up only expands one row per leaf.
    """
    rows = nan_to_null(df).dropna(subset=[*path, *([value] if value else [])])
    total = F.sum(dbl(value)) if value else F.count(F.lit(1)).cast("double")
    leaves = rows.groupBy(*[col(p) for p in path]).agg(total.alias("__total"))
    level = F.lit(len(path)) - F.bit_count(F.grouping_id())
    return (
        leaves.rollup(*[col(p) for p in path])
        .agg(F.sum("__total").alias("total"), level.cast("bigint").alias("level"))
        .where(F.col("level") > 0)
    )


class Pca:
    """Principal components of the standardised numeric columns."""

    def __init__(self, names, fill, mean, std, loadings, explained):
        self.names, self.fill, self.mean, self.std = names, fill, mean, std
        self.loadings, self.explained = loadings, explained

    def variance(self, df: DataFrame) -> DataFrame:
        cumulative = np.cumsum(self.explained)
        rows = [(f"PC{i + 1}", float(v), float(cumulative[i])) for i, v in enumerate(self.explained)]
        return local_frame(df.sparkSession, rows, "component string, explained double, cumulative double")

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One linear expression per component; ``keep`` carries the target or a key along."""
        out = []
        for k in range(len(self.explained)):
            total = F.lit(0.0)
            for j, n in enumerate(self.names):
                z = (F.coalesce(dbl(n), F.lit(self.fill[n])) - F.lit(self.mean[j])) / F.lit(self.std[j])
                total = total + z * F.lit(float(self.loadings[j, k]))
            out.append(total.alias(f"PC{k + 1}"))
        return df.select(*[col(c) for c in keep], *out)


def pca(df: DataFrame, target: str | None = None) -> Pca:
    """Fit on all numeric columns but the target; gaps take the median.

    Only the p x p correlation matrix reaches the driver. Each component is signed so that
    its largest loading (the first of equals) is positive.
    """
    names = numeric_columns(df, exclude=[target] if target else [])
    if len(names) < 2:
        raise ValueError("need at least 2 numeric columns for a projection")
    medians = exact_quantiles(df, names, [0.5])
    fill = {n: medians[n][0] if medians[n][0] is not None else 0.0 for n in names}
    full = df.select(*[F.coalesce(dbl(n), F.lit(fill[n])).alias(n) for n in names])
    row = aggregate(full, [a for n in names for a in (F.avg(col(n)), F.stddev_pop(col(n)))])
    mean = [row[2 * i] or 0.0 for i in range(len(names))]
    std = [row[2 * i + 1] or 1.0 for i in range(len(names))]
    r = pair_correlations(full, names)
    matrix = np.zeros((len(names), len(names)))
    for (a, b), v in r.items():
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = v or 0.0
    values, vectors = np.linalg.eigh(matrix)
    k = min(COMPONENTS, len(names))
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order]
    for c in range(k):
        size = np.abs(loadings[:, c])
        lead = int(np.flatnonzero(size >= size.max() - 1e-9)[0])
        if loadings[lead, c] < 0:
            loadings[:, c] = -loadings[:, c]
    total = float(values.sum()) or 1.0
    explained = np.clip(values[order], 0, None) / total
    return Pca(names, fill, mean, std, loadings, explained)
