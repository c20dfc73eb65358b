"""Preparation, folds, models, scores and explanations on small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepflow.operators import modeling as m


def _frame(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    rows = [
        (i, float(a[i]), None if i % 11 == 0 else float(b[i]), "rst"[i % 3], bool(i % 2), 7,
         float(3 * a[i] - 2 * b[i] + 1), "yes" if a[i] + 0.3 * b[i] > 0 else "no")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id int, a double, b double, c string, f boolean, k int, y double, cls string").repartition(3)


def test_prepare(spark):
    p = m.ml_prepare(_frame(spark).drop("y"), "cls", ["id"])
    assert p.features == ["a", "b", "c_s", "c_t", "f"] and p.classification and p.classes == ["no", "yes"]
    assert p.frame.dropna().count() == 240
    with pytest.raises(ValueError, match="constant"):
        m.ml_prepare(_frame(spark), "k")
    dated = _frame(spark).withColumn("d", F.expr("date_add(date'2024-01-01', id)"))
    with pytest.raises(ValueError, match="date parts"):
        m.ml_prepare(dated, "cls", ["id"])


@pytest.mark.parametrize("n,folds", [(103, 5), (20, 3), (11, 5)])
def test_folds_in_order(spark, n, folds):
    got = m.cv_folds(spark.range(n), ["id"], folds).orderBy("id").toPandas()["fold"]
    want = np.concatenate([np.full(len(c), i) for i, c in enumerate(np.array_split(np.arange(n), folds))])
    assert got.tolist() == want.tolist()


def _stratified(y, folds):
    _, first, codes = np.unique(y, return_index=True, return_inverse=True)
    codes = np.argsort(np.argsort(first))[codes]
    ordered = np.sort(codes)
    k = len(first)
    share = np.array([np.bincount(ordered[i::folds], minlength=k) for i in range(folds)])
    out = np.empty(len(y), dtype=int)
    for c in range(k):
        out[codes == c] = np.arange(folds).repeat(share[:, c])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_folds_by_class(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice(["p", "a", "z"], 97, p=[0.6, 0.3, 0.1])
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(y)], "id int, y string").repartition(4)
    got = m.cv_folds(df, ["id"], 5, "y").orderBy("id").toPandas()["fold"]
    assert got.tolist() == _stratified(y, 5).tolist()


def test_split_sizes(spark):
    df = _frame(spark)
    exact = m.train_test_split(df, ["id"], stratify="cls", exact=True).groupBy("cls").agg(
        F.count("id").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")
    )
    for r in exact.collect():
        assert r["t"] == int(r["n"] * 0.2 + 0.5)
    rough = m.train_test_split(df, ["id"]).where("is_test").count()
    assert 25 < rough < 75


def test_linear_is_recovered(spark):
    t = m.train_and_evaluate(
        _frame(spark).select("id", "a", "b", "y").dropna(), "y", ["id"], only=["Linear Regression"], permute=True
    )
    row = t.metrics.first()
    assert t.best == "Linear Regression" and row["r2"] == pytest.approx(1.0) and row["cv_mean"] == pytest.approx(1.0)
    model = t.models["Linear Regression"]
    weights = {r["feature"]: r["importance"] for r in m.feature_importance(model, t.prepared).collect()}
    assert weights == {"a": pytest.approx(0.6, abs=1e-6), "b": pytest.approx(0.4, abs=1e-6)}
    shuffled = t.permutation["Linear Regression"].collect()
    assert [r["feature"] for r in shuffled] == ["a", "b"] and shuffled[0]["importance"] > 0.5
    curve = m.partial_dependence(model, t.prepared.frame, t.prepared, "a").toPandas()
    assert len(curve) == 50 and np.allclose(np.diff(curve["prediction"]) / np.diff(curve["value"]), 3.0)
    assert set(t.predictions["Linear Regression"].columns) == {"id", "label", "prediction"}


def test_permutation_keeps_the_values(spark):
    """An unused feature loses nothing, whatever the shift."""
    t = m.train_and_evaluate(
        _frame(spark).select("id", "a", F.expr("cast(id % 2 as double)").alias("idle"), F.expr("2 * a").alias("y")),
        "y", ["id"], only=["Linear Regression"], run_cv=False, permute=True,
    )
    found = {r["feature"]: r["importance"] for r in t.permutation["Linear Regression"].collect()}
    assert found["idle"] == pytest.approx(0.0, abs=1e-9) and found["a"] > 0.5


def test_all_classifiers(spark):
    t = m.train_and_evaluate(
        _frame(spark).drop("y"), "cls", ["id"], run_cv=False, trees=5, rounds=3, max_depth=4
    )
    rows = t.metrics.collect()
    assert len(rows) == 4 and all(r["accuracy"] > 0.7 for r in rows)
    for name, model in t.models.items():
        assert m.feature_importance(model, t.prepared).first()["feature"] == "a"
        assert "score" in t.predictions[name].columns


def test_all_regressors_and_three_classes(spark):
    t = m.train_and_evaluate(
        _frame(spark).drop("cls"), "y", ["id"], run_cv=False, trees=5, rounds=3, max_depth=4
    )
    assert t.metrics.count() == 4 and t.best == "Linear Regression"
    t = m.train_and_evaluate(
        _frame(spark).select("id", "a", "b", "c"), "c", ["id"], run_cv=False, trees=3, rounds=2, max_depth=2
    )
    assert t.metrics.count() == 4
    assert m.feature_importance(t.models["Gradient Boosting"], t.prepared).count() == 2


def test_logistic_matches_its_objective(spark):
    """The penalty is that of C = 1: the gradient of loss + |w|^2 / 2 vanishes at the solution."""
    p = m.ml_prepare(_frame(spark).select("id", "a", "b", "cls").dropna(), "cls", ["id"])
    data = p.frame.toPandas()
    model = m.estimators(True, 2, len(data))["Logistic Regression"].fit(p.assembled())
    x, y = data[["a", "b"]].to_numpy(), data["label"].to_numpy()
    w, c = model.coefficients.toArray(), model.intercept
    miss = 1 / (1 + np.exp(-(x @ w + c))) - y
    assert np.abs(x.T @ miss + w).max() < 0.02 and abs(miss.sum()) < 0.02


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="at least 10"):
        m.train_and_evaluate(_frame(spark, 8).drop("y"), "cls", ["id"])


def test_metrics_with_an_unseen_class(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 0.0), (1.0, 3.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    got = m.classification_metrics(df).first()
    assert got["accuracy"] == pytest.approx(0.4) and got["recall"] == pytest.approx(0.4)
    assert got["precision"] == pytest.approx((2 * 0.5 + 2 * 0.5) / 5)
    grid = m.confusion_matrix(df).toPandas()
    assert len(grid) == 16 and grid["count"].sum() == 5


def test_roc(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 2, 300)
    score = (rng.normal(size=300) + label).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(label, score)], "label double, score double")
    pos, neg = score[label == 1], score[label == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert m.roc_auc(df).first()["auc"] == pytest.approx(pairs / (len(pos) * len(neg)))
    full = m.roc_curve(df, drop_intermediate=False).toPandas().sort_values(["fpr", "tpr"])
    assert len(full) == len(set(score)) + 1
    assert np.trapezoid(full["tpr"], full["fpr"]) == pytest.approx(pairs / (len(pos) * len(neg)))
    short = m.roc_curve(df).toPandas().sort_values(["fpr", "tpr"])
    assert len(short) <= len(full) and np.trapezoid(short["tpr"], short["fpr"]) == pytest.approx(pairs / (len(pos) * len(neg)))


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    got = m.regression_metrics(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    assert got["r2"] == pytest.approx(1 - 1.25 / ((y - y.mean()) ** 2).sum())
    assert got["mae"] == pytest.approx(0.5) and got["rmse"] == pytest.approx((1.25 / 3) ** 0.5)


def test_linear_folds_from_sums_are_the_fits(spark, monkeypatch):
    """One scan of cross products gives the scores of five fits, also with a feature that repeats another."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) * [1, 50, 0.01] + [0, 1e4, 3]
    y = x @ [2.0, -0.3, 40.0] + rng.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    prepared = m.ml_prepare(spark.createDataFrame(rows, "id int, a double, b double, c double, y double"), "y", ["id"])
    make = lambda n: m.estimators(False, 0, n)["Linear Regression"]
    quick = {r["fold"]: r["score"] for r in m.cross_validate(prepared, make, ["id"]).collect()}
    fold = np.repeat(np.arange(5), 60)
    for k in range(5):
        a = np.column_stack([np.ones(300), x])
        b = np.linalg.lstsq(a[fold != k], y[fold != k], rcond=None)[0]
        miss, held = y[fold == k] - a[fold == k] @ b, y[fold == k]
        assert abs(quick[k] - (1 - miss @ miss / ((held - held.mean()) ** 2).sum())) < 1e-9
    monkeypatch.setattr(m, "SUMMED_FEATURES", 0)
    fits = {r["fold"]: r["score"] for r in m.cross_validate(prepared, make, ["id"]).collect()}
    assert quick == pytest.approx(fits, abs=1e-8)


def test_confusion_matrix_of_many_classes(spark):
    rows = [(float(i % 150), float((i * 7) % 151)) for i in range(2_000)] + [(None, 1.0)]
    found = m.confusion_matrix(spark.createDataFrame(rows, "label double, prediction double"))
    assert found.count() == 151 * 151 and found.agg({"count": "sum"}).first()[0] == 2_000
    assert m.confusion_matrix(spark.createDataFrame(rows[:9], "label double, prediction double"), [0.0, 1.0]).count() == 4


def test_wide_category_in_a_model(spark):
    """A category of more classes than have flag columns: one sparse vector, importances by class name."""
    rows = [(i, f"k{i % 300:03d}", float(i % 300 == 7) * 10 + (i % 50) * 0.01) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, cat string, y double").withColumn("z", F.col("id") % 11)
    prepared = m.ml_prepare(df, "y", ["id"])
    assert prepared.features == ["cat", "z"] and prepared.widths == [299, 1]
    vectors = {r["id"]: r["features"] for r in prepared.assembled().where("id < 302").collect()}
    assert vectors[0].size == 300 and vectors[0].indices.tolist() == [299]  # the first class has no flag
    assert vectors[7].indices.tolist() == [6, 299] and vectors[307 - 300].values.tolist() == [1.0, 7.0]
    trained = m.train_and_evaluate(df, "y", ["id"], run_cv=True, permute=True, only=["Linear Regression"])
    assert trained.metrics.first()["r2"] > 0.9
    top = m.feature_importance(trained.models["Linear Regression"], trained.prepared, 1).first()
    assert top["feature"] == "cat_k007"
    assert trained.permutation["Linear Regression"].first()["feature"] == "cat"
    assert m.partial_dependence(trained.models["Linear Regression"], trained.test, trained.prepared, "z").count() == 50
