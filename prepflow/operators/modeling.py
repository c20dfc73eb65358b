"""Baseline models: preparing features, splitting, training, scoring and explaining, on MLlib."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepflow.functions.columns import NUMERIC, TEMPORAL, aggregate, col, data_type, dbl, local_frame, nan_to_null, sized
from prepflow.functions.vectors import flags_vector
from prepflow.operators.features import FeatureStep, fit_encodings
from prepflow.operators.frequency import distinct_counts, modes
from prepflow.operators.ordering import framed, index_rows, lagged, running_weights, Frame
from prepflow.operators.quantiles import exact_quantiles
from prepflow.session import checkpoint
from prepflow.sources.tables import row_hash

# fixed values
CLASS_LIMIT = 15  # a numeric target with fewer distinct values is a class
TREES = 100
ROUNDS = 100
LEARNING_RATE = 0.1
BOOST_DEPTH = 3
MAX_DEPTH = 30  # as deep as MLlib grows; a level is a pass over the data, so ask for less where that will do
NODE_MEMORY_MB = 1024  # nodes split per pass
MAX_ITER = 1000
TOP_FEATURES = 20
GRID = 50
MIN_ROWS = 10
MIN_PERMUTE = 20
PERMUTED = 8  # features permuted in one pass, each a copy of the row
TINY = 1e-9
SUMMED_FEATURES = 256  # up to here least squares of folds come from sums of cross products
GRID_BLOCKS = 64  # of the columns of a confusion matrix


# --- preparing ----------------------------------------------------------------------


@dataclass
class Prepared:
    """Numeric feature columns and a numeric ``label``; ``classes`` name the label codes.

    A feature in ``wide`` is the code of a category with many classes (from 0, the first, which has no flag):
    in the vector of features it becomes a flag per class but the first. Such classes, and those of a label
    with very many, stay in the table of their step.
    """

    frame: DataFrame
    features: list[str]
    classification: bool
    classes: list[str] = field(default_factory=list)
    keys: tuple[str, ...] = ()
    wide: dict[str, FeatureStep] = field(default_factory=dict)
    n_classes: int = 0

    @property
    def widths(self) -> list[int]:
        """Entries of the vector for each feature."""
        return [self.wide[n].width - 1 if n in self.wide else 1 for n in self.features]

    def vector(self, values: Sequence[Column]) -> Column:
        """The feature vector of the given values of ``features``."""
        if not self.wide:
            return array_to_vector(F.array(*[v.cast("double") for v in values]))
        named = zip(self.features, self.widths, values)
        return flags_vector([(v - 1, width) if n in self.wide else (v, 0) for n, width, v in named])

    def assembled(self, frame: DataFrame | None = None, keep: Sequence[str] | None = None) -> DataFrame:
        """keys (or ``keep``), label and one feature vector."""
        source = self.frame if frame is None else frame
        kept = [col(k) for k in (self.keys if keep is None else keep)]
        if self.wide:
            return source.select(*kept, "label", self.vector([col(n) for n in self.features]).alias("features"))
        inputs = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="error")
        return inputs.transform(source).select(*kept, "label", "features")

    def names(self, entries: Sequence[int]) -> dict[int, str]:
        """What entries of the feature vector stand for: the classes of these few alone are looked up."""
        out, start = {}, 0
        for name, width in zip(self.features, self.widths):
            here = [e for e in entries if start <= e < start + width]
            if name not in self.wide:
                out.update(dict.fromkeys(here, name))
            elif here:
                codes = [e - start + 1 for e in here]
                found = self.wide[name].table.where(F.col("__code").isin(codes)).collect()
                out.update({r["__code"] - 1 + start: f"{name}_{r['__class']}" for r in found})
            start += width
        return out


def ml_task_type(df: DataFrame, target: str) -> str:
    """classification for text, booleans and numbers with under 15 distinct values."""
    if isinstance(data_type(df, target), (T.StringType, T.BooleanType)):
        return "classification"
    return "classification" if distinct_counts(df, [target])[target] < CLASS_LIMIT else "regression"


def _varying(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns with two different values: one scan, no shuffle."""
    found = aggregate(df, [F.coalesce(F.min(col(n)) != F.max(col(n)), F.lit(False)) for n in names])
    return [n for n, varies in zip(names, found) if varies]


def ml_prepare(df: DataFrame, target: str, keys: Sequence[str] = ()) -> Prepared:
    """Drop constants and rows without target, fill gaps, encode text; ``keys`` ride along unused."""
    frame = nan_to_null(df)
    kept = _varying(frame, [c for c in frame.columns if c not in keys])
    if target not in kept:
        raise ValueError(f"target column {target!r} not found, or constant")
    classification = ml_task_type(frame, target) == "classification"
    frame = frame.where(col(target).isNotNull())
    inputs = [c for c in kept if c != target]
    dates = [c for c in inputs if isinstance(data_type(frame, c), TEMPORAL)]
    if dates:
        raise ValueError(f"take date parts of {dates} first")
    numeric = [c for c in inputs if isinstance(data_type(frame, c), NUMERIC)]
    flags = [c for c in inputs if isinstance(data_type(frame, c), T.BooleanType)]
    texts = [c for c in inputs if c not in numeric and c not in flags]
    missing = aggregate(frame, [F.count(F.when(col(c).isNull(), 1)) for c in inputs])
    gaps = {c for c, k in zip(inputs, missing) if k}
    medians = exact_quantiles(frame, [c for c in numeric if c in gaps], [0.5])
    common = modes(frame, [c for c in flags + texts if c in gaps])
    fills = {c: medians[c][0] if c in numeric else common[c] for c in gaps}
    filled = frame.select(
        *[col(k) for k in keys],
        *[
            F.coalesce(dbl(c) if c in numeric else col(c), F.lit(fills[c])).alias(c) if c in gaps else col(c)
            for c in inputs
        ],
        col(target),
    )
    coding = {c: "onehot" for c in texts} | ({target: "ordinal"} if classification else {})
    steps = {step.column: step for step in fit_encodings(filled, coding)}
    goal = steps.get(target)
    filled = goal.coded(filled, "__label") if goal else filled.withColumn("__label", dbl(target))
    names, plain, wide = [], [], {}
    for c in inputs:
        step = steps.get(c)
        if step is None or step.table is not None:
            names.append(c)
            plain.append(_plain(c))
            if step is not None:
                filled = step.apply_code(filled)
                wide[_plain(c)] = step
            continue
        flagged = FeatureStep("onehot", c, classes=step.classes[1:])
        filled = flagged.apply(filled)
        names += [f"{c}_{category}" for category in flagged.classes]
        plain += [_plain(f"{c}_{category}") for category in flagged.classes]
    if not names:
        raise ValueError("no usable features")
    prepared = filled.select(
        *[col(k) for k in keys],
        *[col(c).cast("bigint" if n in wide else "double").alias(n) for c, n in zip(names, plain)],
        F.col("__label").cast("double").alias("label"),
    )
    classes = (goal.classes or []) if goal else []
    return Prepared(
        prepared, plain, classification, classes, tuple(keys), wide, len(classes) or (goal.width if goal else 0)
    )


def _plain(name: str) -> str:
    """The assembler reads dots as nesting."""
    return name.replace(".", "_").replace("`", "_")


# --- splitting ----------------------------------------------------------------------


def _bucket(keys: Sequence[str], seed: int) -> Column:
    """A reproducible uniform number in [0, 1) from the key's hash."""
    head = F.substring(row_hash(keys, str(seed)), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 32))


def train_test_split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    stratify: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Add ``is_test``. Row hashes decide without a shuffle, so every class is split alike on
    average; ``exact`` numbers the rows in hash order, within each class if asked, and takes
    precisely the first ``test_size`` of them."""
    if not exact:
        return df.withColumn("is_test", _bucket(keys, seed) < F.lit(test_size))
    hashed = df.withColumn("__h", row_hash(keys, str(seed)))
    groups = [stratify] if stratify else []
    indexed = index_rows(hashed, ["__h", *keys], groups, idx="__idx", count="__n")
    is_test = F.col("__idx") < F.round(F.col("__n") * F.lit(test_size))
    return indexed.select(*[col(c) for c in df.columns], is_test.alias("is_test"))


def cv_folds(
    df: DataFrame, order_by: Sequence[str], folds: int = 5, stratify: str | None = None, name: str = "fold"
) -> DataFrame:
    """Add consecutive, unshuffled folds of equal size; with ``stratify`` in equal class shares.

    Classes are taken in the order they first appear, as if their rows were laid end to end
    and dealt to the folds in turn.
    """
    if not stratify:
        indexed = index_rows(df, order_by, idx="__idx", count="__n")
        n = F.col("__n")
        small, extra = F.floor(n / folds), n % folds
        edge = extra * (small + 1)
        fold = F.when(F.col("__idx") < edge, F.floor(F.col("__idx") / (small + 1))).otherwise(
            extra + F.floor((F.col("__idx") - edge) / small)
        )
        return indexed.select(*[col(c) for c in df.columns], fold.cast("int").alias(name))
    placed = index_rows(df, order_by, [stratify], idx="__idx")
    first = F.min(F.struct(*[col(k) for k in order_by])).alias("first")
    classes = df.groupBy(col(stratify).alias("__c")).agg(first, F.count(F.lit(1)).alias("__n"))
    laid = running_weights(classes, [F.col("first")], {"__n": "__end"}).select("__c", "__n", "__end")
    start = F.col("__end") - F.col("__n")

    def dealt(at: Column, fold: int) -> Column:
        """Places before ``at`` that are the ``fold``-th of their round."""
        return F.floor((at - 1 - fold) / folds)

    # a class has dealt(end) - dealt(start) rows in a fold; the folds before the last one have upper bounds
    bounds, upto = [], F.lit(0)
    for i in range(folds - 1):
        upto = upto + dealt(F.col("__end"), i) - dealt(start, i)
        bounds.append(upto)
    laid = laid.select("__c", F.array(*bounds).alias("__bounds"))
    fold = F.size(F.filter("__bounds", lambda b: b <= F.col("__idx")))
    return placed.join(sized(laid), col(stratify).eqNullSafe(F.col("__c"))).select(
        *[col(c) for c in df.columns], fold.cast("int").alias(name)
    )


# --- models -------------------------------------------------------------------------


def estimators(
    classification: bool,
    n_classes: int,
    n_train: int,
    seed: int = 42,
    trees: int = TREES,
    rounds: int = ROUNDS,
    max_depth: int = MAX_DEPTH,
) -> dict[str, object]:
    """The four baseline models by name."""
    forest = {"numTrees": trees, "maxDepth": max_depth, "seed": seed, "maxMemoryInMB": NODE_MEMORY_MB}
    boost = {"maxIter": rounds, "stepSize": LEARNING_RATE, "maxDepth": BOOST_DEPTH, "seed": seed}
    if classification:
        gbt = GBTClassifier(**boost)
        return {
            "Random Forest": RandomForestClassifier(featureSubsetStrategy="sqrt", **forest),
            "Extra Trees": RandomForestClassifier(featureSubsetStrategy="sqrt", bootstrap=False, **forest),
            "Gradient Boosting": gbt if n_classes <= 2 else OneVsRest(classifier=gbt),
            "Logistic Regression": LogisticRegression(
                regParam=1.0 / max(n_train, 1), standardization=False, maxIter=MAX_ITER
            ),
        }
    return {
        "Random Forest": RandomForestRegressor(featureSubsetStrategy="all", **forest),
        "Extra Trees": RandomForestRegressor(featureSubsetStrategy="all", bootstrap=False, **forest),
        "Gradient Boosting": GBTRegressor(**boost),
        "Linear Regression": LinearRegression(regParam=0.0),
    }


def model_predictions(model: Model, assembled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted value per row, and the class-1 probability where the model has one."""
    scored = model.transform(assembled)
    extra = []
    if "probability" in scored.columns:
        extra = [vector_to_array("probability")[1].alias("score")]
    return scored.select(*[col(k) for k in keys], "label", "prediction", *extra)


# --- scoring ------------------------------------------------------------------------


def _outcome_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def classification_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, and F1, precision and recall weighted by class size; empty ratios count 0."""
    counts = _outcome_counts(predictions)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = counts.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = counts.groupBy(F.col("prediction").alias("p")).agg(F.sum("n").alias("guesses"))
    per = actual.join(guessed, F.col("c") == F.col("p"), "left").select(
        "support", "tp", F.coalesce("guesses", F.lit(0)).alias("guesses")
    )
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("guesses")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("guesses")), F.lit(0.0))
    total = F.sum("support")
    return per.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / total).alias("f1"),
        (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"),
    )


def confusion_matrix(predictions: DataFrame, labels: Sequence[float] | None = None) -> DataFrame:
    """Every (label, prediction) pair with its count and its share of the label's row."""
    counts = _outcome_counts(predictions)
    if labels is None:
        pair = F.array(F.struct(F.col("label").alias("v")), F.struct(F.col("prediction").alias("v")))
        known = counts.select(F.inline(pair)).where("v is not null").distinct()
    else:
        known = local_frame(predictions.sparkSession, [[float(v)] for v in labels], "v double")
    # the answer is the whole grid of classes: a row of it meets the other classes in blocks
    blocks = F.explode(F.sequence(F.lit(0), F.lit(GRID_BLOCKS - 1))).alias("block")
    columns = known.select(F.col("v").alias("prediction"), F.pmod(F.xxhash64("v"), F.lit(GRID_BLOCKS)).cast("int").alias("block"))
    grid = known.select(F.col("v").alias("label"), blocks).join(columns, "block").drop("block")
    full = grid.join(counts, ["label", "prediction"], "left").fillna(0, ["n"])
    rows = counts.groupBy("label").agg(F.sum("n").alias("row_n"))
    return full.join(rows, "label", "left").select(
        "label",
        "prediction",
        F.col("n").alias("count"),
        (F.col("n") / (F.coalesce("row_n", F.lit(0)) + F.lit(TINY))).alias("rate"),
    )


def _score_steps(scored: DataFrame, label: str, score: str) -> tuple[DataFrame, int, int]:
    """Positives and negatives per distinct score with running totals from the highest down."""
    steps = (
        scored.where(col(score).isNotNull() & col(label).isNotNull())
        .groupBy((-dbl(score)).alias("__down"))
        .agg(
            F.sum(F.when(col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
            F.sum(F.when(col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
        )
    )
    placed = running_weights(steps, [F.col("__down")], {"pos": "tps", "neg": "fps"})
    pos, neg = (int(v or 0) for v in placed.agg(F.sum("pos"), F.sum("neg")).first())
    return placed, pos, neg


def roc_curve(
    scored: DataFrame, label: str = "label", score: str = "score", drop_intermediate: bool = True
) -> DataFrame:
    """(fpr, tpr, threshold), from the origin (NULL threshold) down the scores.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    placed, pos, neg = _score_steps(scored, label, score)
    points = placed.select("__down", "tps", "fps")
    if drop_intermediate:
        n = points.count()
        indexed = index_rows(points, ["__down"], n=n)
        tps, fps = F.col("tps"), F.col("fps")
        around = {
            "tp0": lagged(tps, 1),
            "fp0": lagged(fps, 1),
            "tp2": Frame(0, 1, lambda w: F.lead(tps).over(w), unframed=True),
            "fp2": Frame(0, 1, lambda w: F.lead(fps).over(w), unframed=True),
        }
        near = framed(indexed, around, n)
        bend = (F.col("tp2") - 2 * tps + F.col("tp0") != 0) | (F.col("fp2") - 2 * fps + F.col("fp0") != 0)
        points = near.where(F.col("tp0").isNull() | F.col("tp2").isNull() | bend).select("__down", "tps", "fps")
    curve = points.select(
        F.try_divide(F.col("fps"), F.lit(float(neg))).alias("fpr"),
        F.try_divide(F.col("tps"), F.lit(float(pos))).alias("tpr"),
        (F.lit(0.0) - F.col("__down")).alias("threshold"),
    )
    origin = local_frame(scored.sparkSession, [(0.0, 0.0, None)], "fpr double, tpr double, threshold double")
    return origin.unionByName(curve)


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the curve by trapezoids: one step per distinct score."""
    placed, pos, neg = _score_steps(scored, label, score)
    before = (F.col("tps") - F.col("pos")).cast("double")
    area = F.sum(F.col("neg") * (2 * before + F.col("pos")) / 2.0)
    return placed.agg(F.try_divide(area, F.lit(float(pos) * float(neg))).alias("auc"))


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """R2, MAE, MSE and RMSE in one aggregate."""
    miss = F.col("label") - F.col("prediction")
    spread = F.var_pop("label") * F.count("label")
    sums = predictions.agg(
        (F.lit(1.0) - F.try_divide(F.sum(miss * miss), spread)).alias("r2"),
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(miss * miss).alias("mse"),
    )
    return sums.withColumn("rmse", F.sqrt("mse"))


def best_model(metrics: DataFrame, score: str) -> DataFrame:
    """The model with the highest score: one row per model comes in."""
    return metrics.orderBy(F.desc(score), "model").limit(1).select("model", score)


def _score(predictions: DataFrame, classification: bool, measure: str | None = None) -> float:
    if classification:
        return float(classification_metrics(predictions).first()[measure or "f1"])
    value = regression_metrics(predictions).first()[measure or "r2"]
    return float("nan") if value is None else float(value)


def cut_folds(prepared: Prepared, order_by: Sequence[str], folds: int = 5) -> DataFrame:
    """fold, label and feature vector of every row: cut once, for any number of models."""
    cut = cv_folds(prepared.frame, order_by, folds, "label" if prepared.classification else None)
    return checkpoint(prepared.assembled(cut, ["fold"]))


def _fold_products(width: int, shift: np.ndarray):
    """Sums of z z' per fold over the rows of a task, z being 1, the features and the label, shifted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            z = np.column_stack([np.ones(len(x)), x - shift[:-1], batch["label"].to_numpy() - shift[-1]])
            folds = batch["fold"].to_numpy()
            for fold in np.unique(folds).tolist():
                part = z[folds == fold]
                sums[fold] = sums.get(fold, 0.0) + part.T @ part
        rows, cols = np.triu_indices(width)
        for fold, total in sums.items():
            columns = [np.full(len(rows), fold), rows, cols, total[rows, cols]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["fold", "i", "j", "s"])

    return run


def _linear_folds(data: DataFrame, folds: int, features: int) -> list[tuple[int, float]]:
    """R2 of least squares on every fold, from the cross products of the folds: one scan, no fit over rows.

    The products of a training set are the total less the fold's own, and those of the fold give its residuals.
    """
    rows = data.select("fold", F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    means = rows.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(features)], F.avg("label")).first()
    shift, width = np.array([float(m) for m in means]), features + 2
    found = rows.mapInArrow(_fold_products(width, shift), "fold int, i int, j int, s double")
    own = np.zeros((folds, width, width))
    for r in found.groupBy("fold", "i", "j").agg(F.sum("s").alias("s")).collect():
        own[r["fold"], r["i"], r["j"]] = own[r["fold"], r["j"], r["i"]] = r["s"]
    total, out = own.sum(axis=0), []
    for fold in range(folds):
        train = total - own[fold]
        scale = np.sqrt(np.maximum(np.diag(train)[:-1], np.finfo(float).tiny))
        b = np.linalg.lstsq(train[:-1, :-1] / np.outer(scale, scale), train[:-1, -1] / scale, rcond=1e-12)[0] / scale
        test = own[fold]
        residual = test[-1, -1] - 2 * b @ test[:-1, -1] + b @ test[:-1, :-1] @ b
        spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0] if test[0, 0] else 0.0
        out.append((fold, float(1.0 - residual / spread) if spread > 0 else float("nan")))
    return out


def cross_validate(
    prepared: Prepared,
    make: Callable[[int], object],
    order_by: Sequence[str],
    folds: int = 5,
    cut: DataFrame | None = None,
) -> DataFrame:
    """(fold, score): weighted F1 or R2 of a fresh model on each held-out fold.

    ``make`` builds the estimator for a training size; ``cut`` are folds already cut. Least squares need no fit
    per fold, see ``_linear_folds``.
    """
    data = cut_folds(prepared, order_by, folds) if cut is None else cut
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    if total < 2 * folds:
        raise ValueError(f"need at least {2 * folds} rows for {folds} folds")
    estimator, entries = make(total), sum(prepared.widths)
    if isinstance(estimator, LinearRegression) and estimator.getRegParam() == 0 and entries <= SUMMED_FEATURES:
        return local_frame(prepared.frame.sparkSession, _linear_folds(data, folds, entries), "fold int, score double")
    rows = []
    for fold in range(folds):
        model = make(total - sizes.get(fold, 0)).fit(data.where(F.col("fold") != fold))
        scored = model.transform(data.where(F.col("fold") == fold)).select("label", "prediction")
        rows.append((fold, _score(scored, prepared.classification)))
    return local_frame(prepared.frame.sparkSession, rows, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


# --- explaining ---------------------------------------------------------------------


def feature_importance(model: Model, prepared: Prepared, top: int = TOP_FEATURES) -> DataFrame:
    """Tree importances, or absolute coefficients scaled to sum 1; strongest first."""
    if hasattr(model, "featureImportances"):
        weights = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "coefficientMatrix"):
        matrix = abs(model.coefficientMatrix.toArray())
        weights = [float(v) for v in matrix.mean(axis=0)]
    elif hasattr(model, "coefficients"):
        weights = [abs(float(v)) for v in model.coefficients.toArray()]
    else:  # one model per class: the mean over the classes
        per_class = [m.featureImportances.toArray() for m in model.models]
        weights = [float(v) for v in sum(per_class) / len(per_class)]
    if not hasattr(model, "featureImportances") and sum(weights) > 0:
        weights = [w / sum(weights) for w in weights]
    first = sorted(range(len(weights)), key=lambda i: -weights[i])[:top]
    names = prepared.names(first)
    rows = [(names[i], weights[i]) for i in first]
    return local_frame(prepared.frame.sparkSession, rows, "feature string, importance double")


def _with_value(at: int, value: Column) -> Column:
    """The feature array ``x`` with one entry replaced."""
    return F.transform("x", lambda v, j: F.when(j == at, value).otherwise(v))


def permutation_importance(
    model: Model,
    test: DataFrame,
    prepared: Prepared,
    keys: Sequence[str],
    repeats: int = 5,
    seed: int = 42,
    top: int = TOP_FEATURES,
) -> DataFrame:
    """Mean and deviation of the score lost when one feature is shuffled between the rows.

    Rows are numbered in a hash order; a repeat hands every row the values of the row a
    random number of places on, by one equi-join on the position. A pass scores ``PERMUTED``
    features, each as its own copy of the row with one value replaced.
    """
    names = prepared.features
    values = test.select(*[col(k) for k in keys], "label", F.array(*[col(n).cast("double") for n in names]).alias("x"))
    hashed = values.withColumn("__h", row_hash(keys, f"order{seed}"))
    n = hashed.count()
    if n < MIN_PERMUTE:
        raise ValueError(f"need at least {MIN_PERMUTE} rows to permute")
    # read once per repeat and pass
    numbered = checkpoint(index_rows(hashed, ["__h", *keys], idx="__at", n=n).select("__at", "label", "x"))
    measure = "accuracy" if prepared.classification else "r2"
    entries = prepared.vector([F.col("x")[i] for i in range(len(names))]).alias("features")
    plain = numbered.select("label", entries)
    base = _score(model.transform(plain).select("label", "prediction"), prepared.classification, measure)
    losses: dict[int, list[float]] = {i: [] for i in range(len(names))}
    for repeat in range(repeats):
        shift = 1 + (seed * 7919 + repeat * 104729) % (n - 1)
        donors = numbered.select(((F.col("__at") + shift) % n).alias("__at"), F.col("x").alias("other"))
        paired = numbered.join(donors, "__at")
        for at in range(0, len(names), PERMUTED):
            changed = [
                F.struct(F.lit(i).alias("feature"), _with_value(i, F.col("other")[i]).alias("x"))
                for i in range(at, min(at + PERMUTED, len(names)))
            ]
            copies = paired.select("label", F.inline(F.array(*changed)))
            scored = model.transform(copies.select("feature", "label", entries))
            if prepared.classification:
                quality = F.avg((F.col("label") == F.col("prediction")).cast("double"))
            else:
                miss = F.col("label") - F.col("prediction")
                quality = F.lit(1.0) - F.try_divide(F.sum(miss * miss), F.var_pop("label") * F.count("label"))
            for r in scored.groupBy("feature").agg(quality.alias("q")).collect():
                losses[r["feature"]].append(base - r["q"])
    rows = []
    for i, name in enumerate(names):
        mean = sum(losses[i]) / repeats
        spread = (sum((v - mean) ** 2 for v in losses[i]) / repeats) ** 0.5
        rows.append((name, mean, spread))
    rows.sort(key=lambda r: -r[1])
    return local_frame(prepared.frame.sparkSession, rows[:top], "feature string, importance double, std double")


def partial_dependence(model: Model, frame: DataFrame, prepared: Prepared, feature: str, points: int = GRID) -> DataFrame:
    """(point, value, prediction): mean prediction with the feature set to each grid value.

    Every row is scored at every grid value where it lies; only grid sums are shuffled.
    """
    at = prepared.features.index(feature)
    low, high = frame.agg(F.min(dbl(feature)), F.max(dbl(feature))).first()
    step = (high - low) / (points - 1)
    grid = F.array(*[F.lit(low + i * step) for i in range(points)])
    rows = frame.select(
        F.array(*[col(n).cast("double") for n in prepared.features]).alias("x"), F.posexplode(grid).alias("point", "value")
    )
    own = [F.col("value") if i == at else F.col("x")[i] for i in range(len(prepared.features))]
    replaced = prepared.vector(own)
    scored = model.transform(rows.select("point", "value", replaced.alias("features")))
    return (
        scored.groupBy("point")
        .agg(F.first("value").alias("value"), F.avg("prediction").alias("prediction"))
        .orderBy("point")
    )


# --- everything ---------------------------------------------------------------------


@dataclass
class Trained:
    """Fitted models with their test metrics."""

    prepared: Prepared
    models: dict[str, Model]
    metrics: DataFrame
    best: str
    n_train: int
    n_test: int
    test: DataFrame
    predictions: dict[str, DataFrame]
    folds: dict[str, DataFrame] = field(default_factory=dict)
    permutation: dict[str, DataFrame] = field(default_factory=dict)


def train_and_evaluate(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = 42,
    run_cv: bool = True,
    folds: int = 5,
    permute: bool = False,
    only: Sequence[str] | None = None,
    **sizes: int,
) -> Trained:
    """Prepare, split, train the baseline models, score them and name the best.

    ``keys`` identify a row: they order it, split it and never become features. ``sizes`` passes ``trees``,
    ``rounds`` and ``max_depth`` on.
    """
    prepared = ml_prepare(df, target, keys)
    classification = prepared.classification
    split = train_test_split(
        prepared.frame, keys, test_size, seed, "label" if classification else None, exact=True
    )
    split = checkpoint(split)  # every model reads it
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    n_train, n_test = train.count(), test.count()
    if n_train + n_test < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows to train")
    fit_on, score_on = prepared.assembled(train), prepared.assembled(test)
    k = prepared.n_classes
    wanted = estimators(classification, k, n_train, seed, **sizes)
    models, predictions, cv, permuted, rows = {}, {}, {}, {}, []
    cut = cut_folds(prepared, keys, folds) if run_cv and n_train + n_test >= 2 * folds else None
    for name, estimator in wanted.items():
        if only is not None and name not in only:
            continue
        started = time.time()
        models[name] = estimator.fit(fit_on)
        seconds = time.time() - started
        predictions[name] = model_predictions(models[name], score_on, keys)
        frame = classification_metrics if classification else regression_metrics
        row = frame(predictions[name]).first().asDict()
        row.update(model=name, fit_time=seconds)
        if cut is not None:
            cv[name] = cross_validate(
                prepared,
                lambda n, name=name: estimators(classification, k, n, seed, **sizes)[name],
                keys,
                folds,
                cut,
            )
            row.update(cv_summary(cv[name]).first().asDict())
        if permute and n_test >= MIN_PERMUTE:
            permuted[name] = permutation_importance(models[name], test, prepared, keys, 3, seed)
        rows.append(row)
    measures = ["accuracy", "f1", "precision", "recall"] if classification else ["r2", "mae", "mse", "rmse"]
    fields = ["model", *measures, "fit_time", "cv_mean", "cv_std"]
    schema = "model string, " + ", ".join(f"`{f}` double" for f in fields[1:])
    metrics = local_frame(df.sparkSession, [[r.get(f) for f in fields] for r in rows], schema)
    best = best_model(metrics, "f1" if classification else "r2").first()["model"]
    return Trained(prepared, models, metrics, best, n_train, n_test, test, predictions, cv, permuted)
