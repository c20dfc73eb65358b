"""Cleaning: duplicates, missing values and outliers, fitted once and applied as one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import (
    FRACTIONAL,
    INTEGRAL,
    NUMERIC,
    aggregate,
    col,
    data_type,
    num,
    local_frame,
    nan_to_null,
)
from prepflow.functions.moments import fences
from prepflow.operators.duplicates import count_duplicates, drop_copies
from prepflow.operators.frequency import modes
from prepflow.operators.ordering import Ranges, carry_fill, cut_ranges
from prepflow.operators.profile import Profile, _null_total
from prepflow.operators.quantiles import exact_quantiles, outlier_tally
from prepflow.session import together

# fixed values
NULL_STRATEGIES = ("none", "drop", "mean", "median", "mode", "ffill", "bfill", "custom", "zero")
OUTLIER_STRATEGIES = ("keep", "cap", "remove")
SKEWED = 1.0
OUTLIER_SHARE = 0.5

LOG_SCHEMA = "step bigint, `column` string, action string, n_affected bigint, detail string"


@dataclass
class ColumnRule:
    null_strategy: str = "none"
    outlier_strategy: str = "keep"
    custom_value: object = None

    def __post_init__(self):
        if self.null_strategy not in NULL_STRATEGIES:
            raise ValueError(f"null_strategy must be one of {', '.join(NULL_STRATEGIES)}")
        if self.outlier_strategy not in OUTLIER_STRATEGIES:
            raise ValueError(f"outlier_strategy must be one of {', '.join(OUTLIER_STRATEGIES)}")


@dataclass
class CleanSpec:
    """What to do, column by column, in order. ``order_by`` is needed by forward and backward fill."""

    remove_duplicates: bool = False
    columns: dict[str, ColumnRule] = field(default_factory=dict)
    order_by: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "CleanSpec":
        rules = {c: ColumnRule(**r) for c, r in d.get("columns", {}).items()}
        return cls(d.get("remove_duplicates", False), rules, tuple(d.get("order_by", ())))


def auto_clean_spec(p: Profile) -> CleanSpec:
    """The recommended rules, from a profile alone."""
    rules = {}
    for name, c in p.columns.items():
        rule = ColumnRule()
        if c["null_count"] > 0:
            if c["kind"] == "numeric":
                rule.null_strategy = "median" if abs(c["raw_skewness"] or 0.0) > SKEWED else "mean"
            elif c["kind"] == "datetime":
                rule.null_strategy = "drop"
            else:
                rule.null_strategy = "mode"
        if c["kind"] == "numeric" and c["outlier_ratio"] * 100 > OUTLIER_SHARE:
            rule.outlier_strategy = "cap"
        rules[name] = rule
    return CleanSpec(True, rules)


def auto_clean_config(p: Profile) -> DataFrame:
    rows = [(n, r.null_strategy, r.outlier_strategy) for n, r in auto_clean_spec(p).columns.items()]
    return local_frame(p.spark, rows, "column string, null_strategy string, outlier_strategy string")


@dataclass
class CleanStep:
    """One fitted action; every field is plain data, so steps can be stored as JSON."""

    op: str
    column: str | None = None
    value: object = None
    as_double: bool = False
    lower: float | None = None
    upper: float | None = None
    order_by: tuple[str, ...] = ()
    strategy: str = ""
    affected: int = 0
    ranges: Ranges | None = None  # of the order of a carry; a later table may use the same ones

    def detail(self) -> str | None:
        if self.op == "fill":
            shown = f"{self.value:.4f}" if isinstance(self.value, float) else str(self.value)
            return f"{self.strategy}={shown}"
        if self.op in ("cap", "remove"):
            return f"[{self.lower:.3f}, {self.upper:.3f}]"
        return None

    @property
    def action(self) -> str:
        names = {
            "dedup": "remove_duplicates",
            "drop": "drop_null_rows",
            "fill": f"fill_{self.strategy}",
            "carry": f"fill_{self.strategy}",
            "cap": "cap_outliers",
            "remove": "remove_outliers",
        }
        return names[self.op]


def _outside(value: Column, step: CleanStep) -> Column:
    return (value < F.lit(step.lower)) | (value > F.lit(step.upper))


def _cell(df: DataFrame, current: Column, step: CleanStep) -> Column:
    """The column expression after a fill or a cap."""
    if step.op == "fill":
        if step.as_double:
            return F.coalesce(current.cast("double"), F.lit(float(step.value)))
        kind = data_type(df, step.column)
        return F.coalesce(current, F.lit(step.value).cast(kind))
    value = current.cast("double")
    # least/greatest skip NULLs, so a missing value must be kept aside
    return F.when(
        value.isNotNull(), F.greatest(F.least(value, F.lit(step.upper)), F.lit(step.lower))
    )


def _carry(df: DataFrame, steps: Sequence[CleanStep]) -> DataFrame:
    """Forward and backward fills that share an order: one shuffle for all of them."""
    first = steps[0]
    ranges = first.ranges or cut_ranges(df, first.order_by)
    return carry_fill(df, {s.column: s.strategy == "ffill" for s in steps}, first.order_by, ranges=ranges)


def apply_steps(df: DataFrame, steps: Sequence[CleanStep]) -> DataFrame:
    """Fills and caps between two row-level steps become one projection. NaN must be NULL already."""
    out = df
    cells: dict[str, Column] = {}
    carried: list[CleanStep] = []

    def flush(frame: DataFrame) -> DataFrame:
        if cells:
            frame = frame.select(*[cells[c].alias(c) if c in cells else col(c) for c in frame.columns])
            cells.clear()
        if carried:
            frame = _carry(frame, carried)
            carried.clear()
        return frame

    for step in steps:
        if step.op == "carry":
            # a fill of its own order's columns, or of a column filled already, comes after what is waiting
            apart = any(step.order_by != c.order_by or step.column == c.column for c in carried)
            if cells or apart or any(c.column in step.order_by for c in carried):
                out = flush(out)
            carried.append(step)
            continue
        if carried:
            out = flush(out)
        if step.op in ("fill", "cap"):
            cells[step.column] = _cell(out, cells.get(step.column, col(step.column)), step)
            continue
        out = flush(out)
        if step.op == "dedup":
            out = drop_copies(out)
        elif step.op == "drop":
            out = out.where(col(step.column).isNotNull())
        elif step.op == "remove":
            value = num(step.column)
            out = out.where(value.isNull() | ~_outside(value, step))
    return flush(out)


@dataclass
class FittedClean:
    """Fitted steps: apply them to this table or to any later one."""

    steps: list[CleanStep]

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_steps(nan_to_null(df), self.steps)

    def log_rows(self) -> list[tuple]:
        return [(s.column, s.action, s.affected, s.detail()) for s in self.steps]

    def changelog(self, spark) -> DataFrame:
        rows = [(i, *r) for i, r in enumerate(self.log_rows(), 1)]
        return local_frame(spark, rows, LOG_SCHEMA)

    def to_dict(self) -> list[dict]:
        return [asdict(s) for s in self.steps]

    @classmethod
    def from_dict(cls, steps: list[dict]) -> "FittedClean":
        again = lambda s: {"order_by": tuple(s["order_by"]), "ranges": Ranges.from_dict(s.get("ranges"))}
        return cls([CleanStep(**{**s, **again(s)}) for s in steps])


def _custom_value(df: DataFrame, name: str, value: object) -> object:
    """The given value in the column's type; an error when it does not fit."""
    kind = data_type(df, name)
    try:
        if isinstance(kind, INTEGRAL):
            number = float(value)
            if number != int(number):
                raise ValueError
            return int(number)
        if isinstance(kind, FRACTIONAL + (T.DecimalType,)):
            return float(value)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[str(value).lower()]
    except (TypeError, ValueError, KeyError):
        raise ValueError(f"{value!r} is not a {kind.simpleString()} (column {name!r})") from None
    cast = df.sparkSession.range(1).select(F.lit(str(value)).try_cast(kind).alias("v")).first()["v"]
    if cast is None:
        raise ValueError(f"{value!r} is not a {kind.simpleString()} (column {name!r})")
    return str(value)


class _Fitter:
    """Walks the rules, batching columns until a step removes rows.

    Within a batch columns do not affect each other, so their fill values come from one
    aggregate and their fences from one more over the filled columns. The number of jobs
    grows with the row-removing steps, not with the columns.
    """

    def __init__(self, df: DataFrame, n: int):
        self._frame, self.n = df, n
        self.steps: list[CleanStep] = []
        self.waiting: list[CleanStep] = []  # taken, but no statistic has looked past them yet
        self.batch: list[tuple[str, ColumnRule]] = []
        self._ranges: dict[tuple[str, ...], Ranges] = {}

    def add(self, name: str, rule: ColumnRule, order_by: Sequence[str]) -> None:
        fill = rule.null_strategy
        if fill in ("drop", "ffill", "bfill"):
            self.flush()
            # a carry of another column changes neither this one nor the order
            only_carries = all(s.op == "carry" and name not in (s.column, *s.order_by) for s in self.waiting)
            missing = self.nulls([name], self._frame if only_carries else self.frame)[name]
            if missing:
                step = CleanStep("drop" if fill == "drop" else "carry", name, strategy=fill, affected=missing)
                if fill == "drop":
                    self.n -= missing
                elif not order_by:
                    raise ValueError(f"{fill} of {name!r} needs order_by: a table has no row order")
                else:
                    step.order_by = tuple(order_by)
                    step.ranges = self.ranges(step.order_by)
                self.take([step])
            rule = ColumnRule("none", rule.outlier_strategy)
        self.batch.append((name, rule))
        if rule.outlier_strategy == "remove":
            self.flush()

    def ranges(self, order_by: tuple[str, ...]) -> Ranges:
        """Bounds of the order, found once: steps in between change how even they are, not what is filled."""
        if order_by not in self._ranges:
            self._ranges[order_by] = cut_ranges(self._frame, order_by, self.n)
        return self._ranges[order_by]

    @property
    def frame(self) -> DataFrame:
        if self.waiting:
            self._frame = apply_steps(self._frame, self.waiting)
            self.waiting = []
        return self._frame

    def take(self, steps: list[CleanStep]) -> None:
        self.steps += steps
        self.waiting += steps

    def nulls(self, names: Sequence[str], frame: DataFrame | None = None) -> dict[str, int]:
        frame = self.frame if frame is None else frame
        return dict(zip(names, aggregate(frame, [F.count(F.when(col(n).isNull(), 1)) for n in names])))

    def flush(self) -> None:
        batch, self.batch = self.batch, []
        if not batch:
            return
        filling = [(n, r) for n, r in batch if r.null_strategy != "none"]
        self.fill(filling)
        numeric = [
            (n, r)
            for n, r in batch
            if r.outlier_strategy != "keep" and isinstance(data_type(self.frame, n), NUMERIC)
        ]
        if not numeric:
            return
        quartiles = exact_quantiles(self.frame, [n for n, _ in numeric], [0.25, 0.75], self.n)
        limits = {n: fences(*quartiles[n]) for n, _ in numeric}
        counts = outlier_tally(self.frame, limits)
        self.n -= sum(counts[n] for n, r in numeric if r.outlier_strategy == "remove")
        self.take(
            [
                CleanStep(r.outlier_strategy, n, lower=limits[n][0], upper=limits[n][1], affected=counts[n])
                for n, r in numeric
                if counts[n]
            ]
        )

    def fill(self, filling: list[tuple[str, ColumnRule]]) -> None:
        if not filling:
            return
        for n, r in filling:
            needs_number = r.null_strategy in ("mean", "median", "zero")
            if needs_number and not isinstance(data_type(self.frame, n), NUMERIC):
                raise ValueError(f"{r.null_strategy} needs a numeric column, {n!r} is not")
        missing = self.nulls([n for n, _ in filling])
        gaps = [(n, r) for n, r in filling if missing[n]]
        by = {k: [n for n, r in gaps if r.null_strategy == k] for k in NULL_STRATEGIES}
        values: dict[str, object] = {}
        values.update(zip(by["mean"], aggregate(self.frame, [F.avg(num(n)) for n in by["mean"]])))
        if by["median"]:
            found = exact_quantiles(self.frame, by["median"], [0.5], self.n)
            values.update({n: q[0] for n, q in found.items()})
        if by["mode"]:
            values.update(modes(self.frame, by["mode"]))
        values.update(dict.fromkeys(by["zero"], 0))
        values.update({n: _custom_value(self.frame, n, r.custom_value) for n, r in gaps if n in by["custom"]})
        self.take(
            [
                CleanStep(
                    "fill", n, values[n], r.null_strategy in ("mean", "median"),
                    strategy=r.null_strategy, affected=missing[n],
                )
                for n, r in gaps
                if values.get(n) is not None
            ]
        )


def fit_clean(df: DataFrame, spec: CleanSpec) -> FittedClean:
    """Find every fill value and limit the spec asks for, on the table with NaN read as NULL."""
    first: list[CleanStep] = []
    start = nan_to_null(df)
    n, copies = count_duplicates(start) if spec.remove_duplicates else (start.count(), 0)
    if copies:
        first = [CleanStep("dedup", affected=copies)]
        # read by every statistics job below; recomputed from source if an executor is lost
        start = drop_copies(start).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitter = _Fitter(start, n - copies)
        for name, rule in spec.columns.items():
            if name in df.columns:
                fitter.add(name, rule, spec.order_by)
        fitter.flush()
    finally:
        if copies:
            start.unpersist()
    return FittedClean(first + fitter.steps)


def apply_cleaning(df: DataFrame, spec: CleanSpec) -> tuple[DataFrame, DataFrame]:
    """(cleaned table, changelog)."""
    fitted = fit_clean(df, spec)
    return fitted.transform(df), fitted.changelog(df.sparkSession)


# --- single operators ---------------------------------------------------------------


def dedup(df: DataFrame) -> DataFrame:
    """One copy of every distinct row, nulls equal."""
    return drop_copies(nan_to_null(df))


def impute(
    df: DataFrame, name: str, strategy: str, value: object = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Fill the nulls of one column."""
    rule = ColumnRule(strategy, custom_value=value)
    return apply_cleaning(df, CleanSpec(columns={name: rule}, order_by=tuple(order_by)))[0]


def drop_null_rows(df: DataFrame, name: str) -> DataFrame:
    return nan_to_null(df).where(col(name).isNotNull())


def outlier_cap(df: DataFrame, name: str) -> DataFrame:
    return apply_cleaning(df, CleanSpec(columns={name: ColumnRule(outlier_strategy="cap")}))[0]


def outlier_remove(df: DataFrame, name: str) -> DataFrame:
    return apply_cleaning(df, CleanSpec(columns={name: ColumnRule(outlier_strategy="remove")}))[0]


def cleaning_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, nulls and duplicates before and after, as one row."""
    (rows_before, dups_before), (rows_after, dups_after), nulls_before, nulls_after = together(
        before.sparkSession,
        lambda: count_duplicates(before),
        lambda: count_duplicates(after),
        lambda: _null_total(before),
        lambda: _null_total(after),
    )
    row = (
        rows_before, rows_after, rows_before - rows_after,
        nulls_before, nulls_after, nulls_before - nulls_after, dups_before, dups_after,
    )
    return local_frame(
        before.sparkSession,
        [row],
        "rows_before bigint, rows_after bigint, rows_removed bigint, nulls_before bigint, "
        "nulls_after bigint, nulls_removed bigint, dups_before bigint, dups_after bigint",
    )
