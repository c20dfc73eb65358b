"""How ready a table is for modelling: seven scores of 0-100 and a weighted total.

What the scores need to know is a handful of counts, found by aggregates; the scores, their
total, the grade and the messages are expressions over one row of these facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import aggregate, col, dbl, local_frame, numeric_columns
from prepflow.operators.profile import _null_total, count_duplicates
from prepflow.session import together

# fixed values
WEIGHTS = {
    "completeness": 0.25,
    "encoding": 0.20,
    "no_duplicates": 0.10,
    "scale_uniformity": 0.15,
    "sample_size": 0.15,
    "class_balance": 0.10,
    "feature_count": 0.05,
}
GRADES = ((88, "Excellent"), (72, "Good"), (55, "Fair"))
LAST_GRADE = "Needs Work"
NULL_PENALTY, COPY_PENALTY = 5, 10  # points per percent
SIZE_BANDS = ((100_000, 100.0), (10_000, 90.0), (1_000, 70.0), (200, 50.0))  # rows from, points
SMALL_PER_ROW, SMALL_LEAST = 0.5, 5.0
FEATURE_BANDS = (  # features over, points, points lost per feature over, points at least
    (200, 100.0, 0.3, 20.0),
    (50, 100.0, 0.8, 60.0),
    (1, 100.0, 0.0, 100.0),
    (0, 30.0, 0.0, 30.0),
)
NO_FEATURES, NO_TARGET, ONE_CLASS, ONE_SCALE = 10.0, 100.0, 50.0, 100.0
LIMITS = {  # a message for scores under these
    "completeness": 75,
    "encoding": 80,
    "no_duplicates": 85,
    "scale_uniformity": 40,
    "class_balance": 60,
    "sample_size": 70,
    "feature_count": 60,
}
FACTS = (
    "n_rows bigint, n_cols bigint, nulls bigint, copies bigint, features bigint, non_numeric bigint, "
    "narrowest double, widest double, rarest bigint, commonest bigint, classes bigint, "
    "has_target boolean, continuous_target boolean"
)


def _bands(value: Column, bands: Sequence[tuple], last: Column) -> Column:
    """The first band whose bound ``value`` reaches."""
    for least, points in reversed(bands):
        last = F.when(value >= least, points).otherwise(last)
    return last


def _percent(part: str, whole: Column) -> Column:
    return F.col(part) / F.greatest(whole, F.lit(1)) * 100


def _floor(points: Column, least: float = 0.0) -> Column:
    return F.greatest(points, F.lit(float(least)))


def _expressions() -> dict[str, Column]:
    """Every score over a row of facts."""
    n, k = F.col("n_rows"), F.col("features")
    features = F.lit(NO_FEATURES)
    for over, points, lost, least in reversed(FEATURE_BANDS):
        features = F.when(k > over, _floor(points - (k - over) * lost, least)).otherwise(features)
    ranges = F.least(F.col("narrowest") / F.col("widest") * 100, F.lit(100.0))
    return {
        "completeness": _floor(100 - NULL_PENALTY * _percent("nulls", n * F.col("n_cols"))),
        "encoding": _floor((1 - F.col("non_numeric") / F.greatest(k, F.lit(1))) * 100),
        "no_duplicates": _floor(100 - COPY_PENALTY * _percent("copies", n)),
        "scale_uniformity": F.coalesce(ranges, F.lit(ONE_SCALE)),
        "sample_size": _bands(n, SIZE_BANDS, _floor(n * SMALL_PER_ROW, SMALL_LEAST)),
        "class_balance": F.when(F.col("classes").isNull(), NO_TARGET)
        .when(F.col("classes") < 2, ONE_CLASS)
        .otherwise(F.col("rarest") / F.col("commonest") * 100),
        "feature_count": features,
    }


def _ranges(df: DataFrame, target: str | None) -> tuple:
    """Smallest and largest value range of the numeric features that vary, if there are two features."""
    names = numeric_columns(df, exclude=[target] if target else [])
    spans = aggregate(df, [F.max(dbl(n)) - F.min(dbl(n)) for n in names]) if len(names) > 1 else []
    spans = [s for s in spans if s]
    return (min(spans), max(spans)) if spans else (None, None)


def _class_sizes(df: DataFrame, target: str | None) -> tuple:
    """Size of the rarest and the commonest class, and the number of classes."""
    if not target or target not in df.columns:
        return None, None, None
    sizes = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    return tuple(sizes.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first())


def scores(df: DataFrame, target: str | None = None, wanted: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """One row: the facts and the wanted scores, reading only what these need."""
    unknown = [name for name in wanted if name not in WEIGHTS]
    if unknown:
        raise ValueError(f"no scores named {unknown}; have {', '.join(WEIGHTS)}")
    wants = set(wanted).__contains__
    jobs = (
        (lambda: count_duplicates(df)) if wants("no_duplicates") else (lambda: (df.count(), None)),
        (lambda: _null_total(df)) if wants("completeness") else (lambda: None),
        (lambda: _ranges(df, target)) if wants("scale_uniformity") else (lambda: (None, None)),
        (lambda: _class_sizes(df, target)) if wants("class_balance") else (lambda: (None, None, None)),
    )
    (n, copies), nulls, ranges, classes = together(df.sparkSession, *jobs)
    numeric = set(numeric_columns(df))
    inputs = [c for c in df.columns if c != target]
    kind = df.schema[target].dataType if target in df.columns else None
    facts = (
        n, len(df.columns), nulls, copies, len(df.columns) - bool(target), sum(c not in numeric for c in inputs),
        *ranges, *classes, bool(target), isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)),
    )
    row = local_frame(df.sparkSession, [facts], FACTS)
    return row.select("*", *[e.cast("double").alias(k) for k, e in _expressions().items() if wants(k)])


def single_score(df: DataFrame, name: str, target: str | None = None) -> DataFrame:
    """One of the seven scores."""
    return scores(df, target, [name]).select(F.round(name, 4).alias(name))


def readiness_score(
    df: DataFrame, target: str | None = None, found: DataFrame | None = None, digits: int = 4
) -> DataFrame:
    """One row: every score, the weighted total and its grade."""
    found = scores(df, target) if found is None else found
    total = F.aggregate(
        F.array(*[F.col(k) * w for k, w in WEIGHTS.items()]), F.lit(0.0), lambda a, b: a + b
    )
    return found.withColumn("total", total).select(
        *[F.round(k, digits).alias(k) for k in WEIGHTS],
        "n_rows",
        "n_cols",
        F.round("total", 1).alias("score"),
        _bands(F.col("total"), GRADES, F.lit(LAST_GRADE)).alias("grade"),
    )


def readiness_issues(df: DataFrame, target: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """The messages of the scores under their limits: (issue, detail)."""
    found = scores(df, target) if found is None else found
    bound = F.when(F.col("completeness") == 0, "at least ").otherwise("")
    missing = (100 - F.col("completeness")) / NULL_PENALTY
    texts = {
        "completeness": ("missing_data", F.format_string("%s%.1f%% of cells missing: impute before training", bound, missing)),
        "encoding": ("encoding", F.format_string("%d non-numeric columns still need encoding", "non_numeric")),
        "no_duplicates": ("duplicates", F.lit("duplicate rows: remove them to avoid leakage")),
        "scale_uniformity": ("scale", F.lit("feature scales vary widely: normalise or standardise")),
        "class_balance": (
            "class_balance",
            F.when(~F.col("continuous_target"), "class imbalance: consider resampling or class weights"),
        ),
        "sample_size": ("sample_size", F.format_string("only %d rows: risk of overfitting", "n_rows")),
        "feature_count": ("feature_count", F.lit("unsuitable number of features: consider reducing dimensions")),
    }
    rows = [
        F.when(
            (F.col(k) < limit) & (F.col("has_target") if k == "class_balance" else F.lit(True)),
            F.struct(F.lit(texts[k][0]).alias("issue"), texts[k][1].alias("detail")),
        )
        for k, limit in LIMITS.items()
    ]
    return found.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
