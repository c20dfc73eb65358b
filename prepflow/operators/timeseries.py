"""One (date, value) series, or many side by side: rolling figures, trend, season, lags, stationarity.

``prepare`` gives every point its dense position; all else works on positions, chunk by chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import col, data_type, dbl, local_frame, micros, round_half_up, sized
from prepflow.operators.correlation import ROUNDING
from prepflow.operators.ordering import (
    Frame,
    chunk_size,
    framed,
    index_rows,
    lagged,
    with_halo,
)
from prepflow.operators.quantiles import counted_quantiles
from prepflow.operators.types import parse_datetime
from prepflow.session import checkpoint

# fixed values
WINDOWS = (7, 14, 30)
DAY = 86_400_000_000
FREQUENCIES = (
    (1, "Hourly / Daily"), (7, "Daily"), (14, "Weekly"), (35, "Monthly"), (100, "Quarterly"),
)
SLOWEST = "Yearly"
SLOPE_LIMIT = 0.001
TINY = 1e-9


@dataclass
class Series:
    """Indexed points: ``keys``, ``t``, ``v``, tie-breakers, ``idx`` and ``n`` (points in the series)."""

    frame: DataFrame
    keys: tuple[str, ...] = ()
    dropped: int = 0
    _n: int | None = None
    is_settled: bool = False

    def settled(self) -> "Series":
        """The same series with its positions written down: for work that reads them several times."""
        return self if self.is_settled else replace(self, frame=checkpoint(self.frame), is_settled=True)

    @property
    def n(self) -> int:
        """Length of the (longest) series."""
        if self._n is None:
            self._n = int(self.frame.agg(F.max("n")).first()[0] or 0)
        return self._n


def _as_time(df: DataFrame, name: str) -> Column:
    if isinstance(data_type(df, name), T.StringType):
        return parse_datetime(F.trim(col(name)))
    return col(name)


def prepare(
    df: DataFrame, date: str, value: str, tie_breakers: Sequence[str], keys: Sequence[str] = ()
) -> Series:
    """Parse dates, drop points without date or value, sort and number them."""
    v = dbl(value)
    points = df.select(
        *[col(k) for k in keys],
        *[col(k) for k in tie_breakers],
        _as_time(df, date).alias("t"),
        F.when(~F.isnan(v), v).alias("v"),
    )
    present = points.where(F.col("t").isNotNull() & F.col("v").isNotNull())
    if keys:
        sizes = present.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("c"))
        rows, longest = (int(v or 0) for v in sizes.agg(F.sum("c"), F.max("c")).first())
    else:
        rows = longest = present.count()
    indexed = index_rows(present, ["t", *tie_breakers], keys, count="n", n=rows)
    return Series(indexed, tuple(keys), _n=longest)


def infer_frequency(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """Label of the median gap between consecutive dates.

    Works on the distinct dates with their counts, so a date shared by many rows costs one row.
    """
    parsed = df.select(*[col(k) for k in keys], _as_time(df, date).alias("t")).where(F.col("t").isNotNull())
    stamped = parsed.select(*[col(k) for k in keys], micros(parsed, "t").alias("t"), F.lit(0).alias("__all"))
    by = [*keys, "__all"]
    # bounds, positions and sizes each read the dates: they are counted once
    days = checkpoint(stamped.groupBy(*[col(k) for k in by], "t").agg(F.count(F.lit(1)).alias("c")))
    dates = days.groupBy(*[col(k) for k in by]).agg(F.count(F.lit(1)).alias("n"))
    rows, n = (int(v or 0) for v in dates.agg(F.sum("n"), F.max("n")).first())
    indexed = index_rows(days, ["t"], keys, n=rows)
    gaps = framed(indexed, {"__before": lagged(F.col("t"), 1)}, n, keys)
    weighted = gaps.select(
        *[col(k) for k in by],
        F.inline(
            F.array(
                F.struct((F.col("t") - F.col("__before")).cast("double").alias("gap"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(0.0).alias("gap"), (F.col("c") - 1).alias("w")),
            )
        ),
    ).where(F.col("gap").isNotNull() & (F.col("w") > 0))
    counts = checkpoint(weighted.groupBy(*[col(k) for k in by], "gap").agg(F.sum("w").alias("w")))
    medians = counted_quantiles(counts, by, "gap", "w", [0.5])
    sizes = days.groupBy(*[col(k) for k in by]).agg(F.sum("c").alias("n_dates"))
    span = F.floor(F.col("q0") / F.lit(DAY)).cast("bigint")
    label = F.lit(SLOWEST)
    for limit, name in reversed(FREQUENCIES):
        label = F.when(span <= limit, name).otherwise(label)
    joined = sizes.join(
        medians.select(*[col(k).alias(f"__m{i}") for i, k in enumerate(by)], "q0"),
        [col(k).eqNullSafe(F.col(f"__m{i}")) for i, k in enumerate(by)],
        "left",
    )
    known = F.col("n_dates") >= 3
    return joined.select(
        *[col(k) for k in keys],
        "n_dates",
        F.when(known, span).alias("median_days"),
        F.when(known & F.col("q0").isNotNull(), label).otherwise("Unknown").alias("frequency"),
    )


# --- rolling figures ----------------------------------------------------------------


def _full(expr: Column, value: Column, window: int):
    return lambda w: F.when(F.count(value).over(w) == window, expr.over(w))


def rolling_frames(value: Column, window: int, stats: Sequence[str]) -> dict[str, Frame]:
    """Mean and std are centred, min and max trail; a window that is not full gives NULL."""
    centred = (window // 2, (window - 1) // 2)
    trailing = (window - 1, 0)
    spec = {
        "mean": (F.avg(value), centred),
        "std": (F.stddev_samp(value), centred),
        "min": (F.min(value), trailing),
        "max": (F.max(value), trailing),
    }
    return {
        f"{s}_{window}": Frame(*spec[s][1], _full(spec[s][0], value, window)) for s in stats
    }


def rolling(
    series: Series,
    windows: Sequence[int] = WINDOWS,
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    skip_short: bool = True,
    chunk: int | None = None,
) -> DataFrame:
    """Rolling columns ``{stat}_{window}``; windows not shorter than the series stay NULL."""
    columns: dict[str, Frame] = {}
    for w in windows:
        columns.update(rolling_frames(F.col("v"), w, stats))
    out = framed(series.frame, columns, series.n, series.keys, size=chunk)
    if skip_short:
        out = out.withColumns(
            {f"{s}_{w}": F.when(F.col("n") > w, F.col(f"{s}_{w}")) for w in windows for s in stats}
        )
    return out


def ts_line(series: Series, window: int = 7) -> DataFrame:
    """Points and their rolling mean, if the series is longer than the window."""
    return rolling(series, [window], ["mean"])


def ts_rolling_panel(series: Series, window: int = 7) -> DataFrame:
    """Points, rolling mean and rolling standard deviation."""
    return rolling(series, [window], ["mean", "std"], skip_short=False)


# --- trend and summary --------------------------------------------------------------


def _direction(slope: Column) -> Column:
    return F.when(slope > SLOPE_LIMIT, "Upward").when(slope < -SLOPE_LIMIT, "Downward").otherwise("Flat")


def trend_slope(series: Series) -> DataFrame:
    """Least-squares slope per position and its direction."""
    slope = F.regr_slope(F.col("v"), F.col("idx").cast("double"))
    found = series.frame.groupBy(*[col(k) for k in series.keys]).agg(slope.alias("s"))
    return found.select(
        *[col(k) for k in series.keys],
        F.round("s", 6).alias("slope"),
        F.when(F.col("s").isNotNull(), _direction(F.col("s"))).otherwise("Unknown").alias("direction"),
    )


def ts_summary(
    df: DataFrame, date: str, value: str, tie_breakers: Sequence[str], max_lags: int | None = None
) -> DataFrame:
    """One row: size, range, value figures, trend and stationarity of a single series.

    ``max_lags`` bounds the lag orders that the unit-root test tries.
    """
    series = prepare(df, date, value, tie_breakers)
    if series.n < 5:
        raise ValueError("not enough points for time series analysis (need 5)")
    series = series.settled()
    adf = adf_test(series, max_lags)
    v, slope = F.col("v"), F.regr_slope(F.col("v"), F.col("idx").cast("double"))
    row = series.frame.agg(
        F.count(F.lit(1)).alias("n_points"),
        F.date_format(F.min("t"), "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("end"),
        F.avg(v).alias("m"),
        F.stddev_samp(v).alias("s"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        slope.alias("slope"),
    )
    dropped = df.count() - series.n
    return row.select(
        "n_points",
        "start",
        "end",
        F.round("m", 4).alias("mean"),
        F.round("s", 4).alias("std"),
        F.round("lo", 4).alias("min"),
        F.round("hi", 4).alias("max"),
        F.round(F.col("s") / (F.col("m") + TINY) * 100, 2).alias("cv_pct"),
        F.round("slope", 6).alias("slope"),
        _direction(F.col("slope")).alias("direction"),
        F.lit(round_half_up(adf["statistic"], 6)).alias("adf_statistic"),
        F.lit(round_half_up(adf["p_value"], 6)).alias("adf_p_value"),
        F.lit(adf["is_stationary"]).alias("stationary"),
        F.lit(dropped).cast("bigint").alias("dropped_points"),
    )


def variance_ratio(series: Series) -> DataFrame:
    """Variance of the second half over the first; near 1 suggests a stable spread."""
    half = F.floor(F.col("n") / 2)
    first = F.var_samp(F.when(F.col("idx") < half, F.col("v")))
    second = F.var_samp(F.when(F.col("idx") >= half, F.col("v")))
    found = series.frame.groupBy(*[col(k) for k in series.keys]).agg(
        F.count(F.lit(1)).alias("n_points"), (second / (first + TINY)).alias("ratio")
    )
    return found.withColumn("stationary", (F.col("ratio") > 0.5) & (F.col("ratio") < 2.0))


# --- lags ---------------------------------------------------------------------------


def autocorr_lags(series: Series, max_lag: int = 7) -> DataFrame:
    """Correlation of the series with itself ``lag`` points earlier, strongest first.

    Positions are dense, so which points have a partner is known from the position alone:
    only the products need the lagged values, and with them the one shuffle into chunks.
    """
    series = series.settled()
    keys = [col(k) for k in series.keys]
    lags = range(1, max_lag + 1)
    x = F.col("v") - F.lit(series.frame.agg(F.avg("v")).first()[0] or 0.0)
    later, earlier = F.col("idx"), F.col("n") - F.col("idx")
    single = [F.max("n").alias("n")]
    for k in lags:
        for name, value in (("", x), ("2", x * x)):
            single.append(F.sum(F.when(later >= k, value)).alias(f"x{name}_{k}"))
            single.append(F.sum(F.when(earlier > k, value)).alias(f"y{name}_{k}"))
    sums = series.frame.groupBy(*keys, F.lit(0).alias("__all")).agg(*single)
    moved = framed(
        series.frame.withColumn("v", x), {f"l{k}": lagged(F.col("v"), k) for k in lags}, series.n, series.keys
    )
    names = [f"__k{i}" for i in range(len(keys))]
    products = moved.groupBy(*[k.alias(a) for k, a in zip(keys, names)], F.lit(0).alias("__one")).agg(
        *[F.sum(F.col("v") * F.col(f"l{k}")).alias(f"xy_{k}") for k in lags]
    )
    same = [F.col("__all") == F.col("__one")] + [k.eqNullSafe(F.col(a)) for k, a in zip(keys, names)]
    wide = sums.join(sized(products) if keys else F.broadcast(products), same)  # one row without keys

    def coefficient(k: int) -> Column:
        n = F.col("n") - k
        sx, sy, xx, yy, xy = (F.col(f"{p}_{k}") for p in ("x", "y", "x2", "y2", "xy"))
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        varies = (n > 0) & (vx > ROUNDING * xx) & (vy > ROUNDING * yy)
        return F.when(varies, (xy - sx * sy / n) / F.sqrt(vx * vy))

    cells = [F.struct(F.lit(k).cast("bigint").alias("lag"), coefficient(k).alias("r")) for k in lags]
    long = wide.select(*keys, "n", F.inline(F.array(*cells)))
    usable = (F.col("lag") < F.floor(F.col("n") / 2)) & F.col("r").isNotNull()
    found = long.where(usable).select(*keys, "lag", F.round("r", 4).alias("autocorr"))
    ranked = found.orderBy(*keys, F.desc(F.abs("autocorr")), "lag")
    return ranked if keys else ranked.limit(max_lag)  # a top-k of one series needs no second pass


def lag_strength(lags: DataFrame, top: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Band every lag and keep the recommended ones of each series: at most ``max_lag`` rows per series come in."""
    size = F.abs("autocorr")
    band = F.when(size > 0.5, "Strong").when(size > 0.2, "Moderate").otherwise("Weak")
    banded = lags.withColumn("strength", band)
    if not keys:
        return banded.orderBy(F.desc(size), "lag").limit(top)
    order = Window.partitionBy(*[col(k) for k in keys]).orderBy(F.desc(size), "lag")
    return banded.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= top).drop("__rank")


# --- decomposition ------------------------------------------------------------------


def default_period(n: int) -> int:
    return max(2, min(12, n // 4))


def _moving_trend(m: int) -> Frame:
    """Centred moving average over one period; an even period gives its two ends half weight."""
    h = m // 2
    v = F.col("v")

    def evaluate(w):
        total = F.sum(v).over(w)
        if m % 2 == 0:
            total = total - (F.first(v).over(w) + F.last(v).over(w)) / 2
        return F.when(F.count(v).over(w) == 2 * h + 1, total / m)

    return Frame(h, h, evaluate)


def _per_series(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give rows the values of the one row that ``right`` has for their ``names``, nulls equal.

    Without names there is one row for all, or none and no rows.
    """
    if not names:
        row = right.first()
        found = left if row else left.where(F.lit(False))
        return found.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in right.schema})
    there = right.withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(names)})
    same = [col(n).eqNullSafe(F.col(f"__r{i}")) for i, n in enumerate(names)]
    return left.join(sized(there), same).drop(*[f"__r{i}" for i in range(len(names))])


def decompose(series: Series, period: int | None = None) -> DataFrame:
    """Additive trend + season + residual of every series.

    The trend's undefined ends continue the straight line through the nearest ``period``
    defined points; the season is the centred mean of each phase. All series share the period, by
    default that of the longest; a series shorter than two periods (or ten points) among
    others has no parts, a single one is refused.
    """
    n = series.n
    if n < 10:
        raise ValueError("need at least 10 points for a decomposition")
    m = default_period(n) if period is None else period
    if n < 2 * m:
        raise ValueError(f"need at least {2 * m} points for period {m}")
    idx, size, reach = F.col("idx"), F.col("n"), m // 2
    back = size - 1 - reach
    ends = ((F.lit(reach), F.least(F.lit(reach + m), back)), (F.greatest(F.lit(reach), back - m), back))
    series = series.settled()
    frame, by = series.frame, list(series.keys)
    near = frame.where((idx < ends[0][1] + reach) | (idx >= ends[1][0] - reach))
    x = idx.cast("double")
    fitted = [
        agg(F.when((idx >= lo) & (idx < hi), F.col("trend")), x).alias(f"__{name}{k}")
        for k, (lo, hi) in enumerate(ends)
        for name, agg in (("slope", F.regr_slope), ("start", F.regr_intercept))
    ]
    lines = framed(near, {"trend": _moving_trend(m)}, n, series.keys).groupBy(*[col(k) for k in by]).agg(*fitted)
    whole = _per_series(framed(frame, {"trend": _moving_trend(m)}, n, series.keys), lines, by)

    def line(k: int) -> Column:
        return x * F.coalesce(f"__slope{k}", F.lit(0.0)) + F.coalesce(f"__start{k}", F.lit(0.0))

    long_enough = size >= max(10, 2 * m)
    trend = F.when(idx < reach, line(0)).when(idx > back, line(1)).otherwise(F.col("trend"))
    phased = whole.withColumn("trend", F.when(long_enough, trend)).withColumns(
        {"phase": (idx % m).cast("bigint"), "rest": F.col("v") - F.col("trend")}
    )
    phases = phased.groupBy(*[col(k) for k in by], "phase").agg(F.avg("rest").alias("mean"))
    centres = phases.groupBy(*[col(k) for k in by]).agg(F.avg("mean").alias("centre"))
    season = _per_series(phases, centres, by).select(
        *[col(k) for k in by], "phase", (F.col("mean") - F.col("centre")).alias("seasonal")
    )
    if not by:
        season = F.broadcast(season)  # one row per phase
    out = _per_series(phased, season, [*by, "phase"]).withColumn("resid", F.col("rest") - F.col("seasonal"))
    return out.select(*[col(c) for c in series.frame.columns], "trend", "seasonal", "resid")


def decompose_ma(series: Series, period: int | None = None) -> DataFrame:
    """Simple variant: moving averages that shrink at the ends, for trend and then for season."""
    w = period or default_period(series.n)
    reach = (w // 2, (w - 1) // 2)
    trended = framed(
        series.frame, {"trend": Frame(*reach, lambda o: F.avg("v").over(o))}, series.n, series.keys
    ).withColumn("rest", F.col("v") - F.col("trend"))
    out = framed(trended, {"seasonal": Frame(*reach, lambda o: F.avg("rest").over(o))}, series.n, series.keys)
    return out.withColumn("resid", F.col("rest") - F.col("seasonal")).drop("rest")


# --- stationarity -------------------------------------------------------------------

# fixed values: published response surfaces for the constant-only case
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SPLIT, P_MIN, P_MAX = -1.61, -18.83, 2.74
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809),
}


def adf_p_value(statistic: float) -> float:
    """Approximate p-value of a unit-root t statistic."""
    if statistic > P_MAX:
        return 1.0
    if statistic < P_MIN:
        return 0.0
    terms = P_SMALL if statistic <= P_SPLIT else P_LARGE
    z = sum(c * statistic**i for i, c in enumerate(terms))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def adf_critical(n_obs: int) -> dict[str, float]:
    return {k: sum(c / n_obs**i for i, c in enumerate(terms)) for k, terms in CRITICAL.items()}


def _lag_rows(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Regression rows for positions ``first`` .. end: 1, level, lagged changes, change."""
    change = np.diff(x)
    rows = len(x) - first
    out = np.empty((rows, lags + 3))
    out[:, 0] = 1.0
    out[:, 1] = x[first - 1 : len(x) - 1]
    for k in range(1, lags + 1):
        out[:, 1 + k] = change[first - 1 - k : len(change) - k]
    out[:, lags + 2] = change[first - 1 :]
    return out


def _adf_lags(n: int, most: int | None = None) -> int:
    """The largest lag order tried; below 0 the series is too short."""
    lags = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    return lags if most is None else min(lags, most)


def _products(part: pd.DataFrame, lags: int) -> pd.DataFrame:
    """Sum of z z' over the regression rows of one chunk, and the first points of its series."""
    width = lags + 3
    rows, cols = np.triu_indices(width)
    part = part.sort_values("idx")
    x = part["v"].to_numpy(dtype=float) - float(part["centre"].iloc[0])
    first = max(int((~part["is_halo"]).to_numpy().argmax()), lags + 1)
    total = np.zeros((width, width))
    block = max(256, (1 << 22) // width)
    for at in range(first, len(x), block):
        z = _lag_rows(x[at - lags - 1 : at + block], lags + 1, lags)
        total += z.T @ z
    out = pd.DataFrame({"i": rows, "j": cols, "s": total[rows, cols]})
    if part["chunk"].iloc[0] == 0:
        head = x[: lags + 1]
        out = pd.concat([out, pd.DataFrame({"i": -1, "j": np.arange(len(head)), "s": head})])
    return out


def _solve(products: np.ndarray, used: Sequence[int], response: int):
    """Least squares from cross products: coefficients, residual sum of squares, inverse diagonal."""
    x = products[np.ix_(used, used)]
    scale = np.sqrt(np.where(np.diag(x) > 0, np.diag(x), 1.0))
    inverse = np.linalg.pinv(x / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    right = products[used, response]
    beta = inverse @ right
    ssr = float(products[response, response] - beta @ right)
    return beta, max(ssr, 0.0), np.diag(inverse)


def _adf_solve(part: pd.DataFrame, n: int, lags: int) -> dict:
    """The test of one series from its summed cross products (i, j, s) and first points (i = -1)."""
    width, response, rows = lags + 3, lags + 2, n - 1 - lags
    at = part[part["i"] >= 0]
    products = np.zeros((width, width))
    products[at["i"], at["j"]] = products[at["j"], at["i"]] = at["s"]
    head = part[part["i"] < 0].sort_values("j")["s"].to_numpy(dtype=float)
    best = None
    for k in range(lags + 1):
        used = list(range(k + 2))
        _, ssr, _ = _solve(products, used, response)
        aic = rows * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / rows) + 1) + 2 * len(used)
        if best is None or aic < best[0]:
            best = (aic, k)
    k = best[1]
    keep = [*range(k + 2), response]
    final = products[np.ix_(keep, keep)].copy()
    if k < lags:  # the rows that a smaller order gains at the start of the series
        z = _lag_rows(head, k + 1, k)
        final += z.T @ z
    n_obs = n - 1 - k
    beta, ssr, inverse = _solve(final, list(range(k + 2)), k + 2)
    sigma = ssr / (n_obs - k - 2)
    statistic = float(beta[1] / math.sqrt(sigma * inverse[1]))
    p = adf_p_value(statistic)
    critical = adf_critical(n_obs)
    return {
        "statistic": statistic,
        "p_value": p,
        "lags_used": k,
        "n_obs": n_obs,
        **{f"critical_{level.rstrip('%')}": c for level, c in critical.items()},
        "is_stationary": p < 0.05,
    }


ADF_FIELDS = (
    "statistic double, p_value double, lags_used bigint, n_obs bigint, "
    "critical_1 double, critical_5 double, critical_10 double, is_stationary boolean"
)
ADF_CHUNK = 1 << 16  # points that one call holds


def adf_frame(series: Series, max_lags: int | None = None, chunk: int = ADF_CHUNK) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC: one row per series.

    The orders tried go up to 12 (n / 100) ^ 1/4, or to ``max_lags`` if that is less.

    Every chunk of points sums the cross products for the largest lag order; every smaller
    order is a sub-matrix of the totals, so one pass serves all orders. A series that is too
    short or constant has a row of NULLs.
    """
    series = series.settled()
    names = [f"__k{i}" for i in range(len(series.keys))]
    by = names
    keyed = series.frame.select(*[col(k).alias(a) for k, a in zip(series.keys, names)], "idx", "v", "n")
    facts = keyed.groupBy(*by).agg(
        F.max("n").alias("size"), F.avg("v").alias("centre"), (F.min("v") < F.max("v")).alias("varies")
    )
    usable = facts.where(F.col("varies") & (F.col("size") >= 4)).select(*by, "centre")
    reach = max(_adf_lags(series.n, max_lags), 0) + 1
    points = _per_series(keyed, usable, by)
    halo = with_halo(points, reach, 0, max(chunk, reach))
    types = {f.name: f.dataType.simpleString() for f in halo.schema}
    lead = "".join(f"`{k}` {types[k]}, " for k in by)

    def add_up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        out = _products(part, _adf_lags(n, max_lags))
        for k, value in zip([*by, "n"], [*key[:-1], n]):
            out[k] = value
        return out[[*by, "n", "i", "j", "s"]]

    sums = (
        halo.groupBy(*by, "chunk")
        .applyInPandas(add_up, f"{lead}n bigint, i int, j int, s double")
        .groupBy(*by, "n", "i", "j")
        .agg(F.sum("s").alias("s"))
    )

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].iloc[0])
        found = _adf_solve(part, n, _adf_lags(n, max_lags))
        return pd.DataFrame([{**dict(zip(by, key)), **found}])

    found = sums.groupBy(*by).applyInPandas(solve, f"{lead}{ADF_FIELDS}")
    fields = [f.split()[0] for f in ADF_FIELDS.split(", ")]
    if not by:
        row = found.first()
        return local_frame(series.frame.sparkSession, [row or [None] * len(fields)], ADF_FIELDS)
    there = found.withColumnsRenamed({k: f"{k}_r" for k in by})
    out = facts.join(there, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in by], "left")
    return out.select(*[F.col(a).alias(k) for k, a in zip(series.keys, names)], *fields)


def adf_test(series: Series, max_lags: int | None = None, chunk: int = ADF_CHUNK) -> dict:
    """The test of a single series, which must be long enough and vary."""
    if series.keys:
        raise ValueError("several series: adf_frame has a row for each")
    if _adf_lags(series.n) < 0:
        raise ValueError("series is too short for a unit-root test")
    row = adf_frame(series, max_lags, chunk).first()
    if row["statistic"] is None:
        raise ValueError("series is constant")
    out = row.asDict()
    out["critical_values"] = {level: out.pop(f"critical_{level.rstrip('%')}") for level in CRITICAL}
    return out
