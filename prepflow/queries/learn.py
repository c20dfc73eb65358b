"""Model preparation, training, scoring and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepflow.functions.vectors import vector_parts
from prepflow.operators import modeling
from prepflow.queries.registry import View, query, table

# Orders as a modelling table: gaps, a category, a flag and a key.
ORDERS_ML = View(
    "orders",
    [
        "o_orderkey",
        "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END AS cust",
        "CAST(year(o_orderdate) AS INT) AS y",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "month(o_orderdate) > 6 AS late",
        "1 AS flat",
        "o_totalprice",
        "o_orderstatus",
    ],
)
# A labelled score for the metrics: 1 when a click, scored by the value of the event.
SCORED = View(
    "events",
    [
        "event_id",
        "CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS label",
        "round(value, 0) AS score",
        "CAST(CASE WHEN value > 20 THEN 1 ELSE 0 END AS DOUBLE) AS prediction",
    ],
)
# Three classes, one of them never predicted.
GUESSED = View(
    "orders",
    [
        "o_orderkey",
        "CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS label",
        "CAST(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS DOUBLE) AS prediction",
    ],
)
FITTED_LINE = View("lineitem", ["l_extendedprice AS label", "l_quantity * 1000.0 AS prediction"])


def _line(spark, sf):
    """Price from quantity: one row per order line, keyed by a hash of its values."""
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice"
    )
    return df


LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_PRIORITY_FLAGS = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "ml_prepare",
    f"""WITH b AS ({ORDERS_ML.sql}), p AS (SELECT *, coalesce(priority, (SELECT priority FROM b WHERE priority IS NOT NULL
            GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS pr FROM b)
    SELECT o_orderkey, coalesce(cust, (SELECT quantile_cont(cust, 0.5) FROM b))::DOUBLE AS cust, y::DOUBLE AS y,
        {", ".join(f'''(pr = '{v}')::INT::DOUBLE AS "priority_{v}"''' for v in _PRIORITY_FLAGS)},
        late::INT::DOUBLE AS late, o_totalprice, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS label FROM p""",
)
def _(spark, sf):
    return modeling.ml_prepare(ORDERS_ML.df(spark, sf), "o_orderstatus", ["o_orderkey"]).frame


@query(
    "ml_task_type",
    """SELECT 'o_orderstatus' AS target, 'classification' AS task
    UNION ALL SELECT 'y', CASE WHEN count(DISTINCT year(o_orderdate)) < 15 THEN 'classification' ELSE 'regression' END FROM orders
    UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 15 THEN 'classification' ELSE 'regression' END FROM orders""",
)
def _(spark, sf):
    df = ORDERS_ML.df(spark, sf)
    rows = [(t, modeling.ml_task_type(df, t)) for t in ("o_orderstatus", "y", "o_totalprice")]
    return spark.createDataFrame(rows, "target string, task string")


@query(
    "train_test_split",
    "SELECT o_orderkey, ('0x' || substr(md5('42|' || o_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.2 AS is_test FROM orders",
)
def _(spark, sf):
    return modeling.train_test_split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "train_test_split_exact",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey::VARCHAR), o_orderkey) - 1
        < round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return modeling.train_test_split(df, ["o_orderkey"], stratify="o_orderstatus", exact=True)


@query(
    "cv_folds",
    """SELECT o_orderkey, (CASE WHEN i < e * (s + 1) THEN i // (s + 1) ELSE e + (i - e * (s + 1)) // s END)::INT AS fold FROM (
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () // 7 AS s, count(*) OVER () % 7 AS e FROM orders)""",
)
def _(spark, sf):
    return modeling.cv_folds(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "cv_folds_stratified",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS j,
            min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS first_key FROM orders),
    c AS (SELECT o_orderstatus, first_key, count(*) AS n FROM o GROUP BY 1, 2),
    s AS (SELECT o_orderstatus, n, (coalesce(sum(n) OVER (ORDER BY first_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS st FROM c),
    f AS (SELECT o_orderstatus, k, (SELECT count(*) FROM range(s.st, s.st + s.n) r(p) WHERE p % 5 = k) AS size FROM s, range(5) q(k)),
    u AS (SELECT o_orderstatus, k, sum(size) OVER (PARTITION BY o_orderstatus ORDER BY k) - size AS lo,
            sum(size) OVER (PARTITION BY o_orderstatus ORDER BY k) AS hi FROM f)
    SELECT o.o_orderkey, o.o_orderstatus, u.k::INT AS fold FROM o JOIN u ON o.o_orderstatus = u.o_orderstatus AND o.j >= u.lo AND o.j < u.hi""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return modeling.cv_folds(df, ["o_orderkey"], 5, "o_orderstatus")


# --- models --------------------------------------------------------------------------


def _train(spark, sf, name, view, target, key="o_orderkey", **options):
    options.setdefault("run_cv", False)
    only = None if name is None else [name]
    return modeling.train_and_evaluate(view.df(spark, sf), target, [key], only=only, **options)


@query(
    "train_linear",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept
       FROM lineitem""",
)
def _(spark, sf):
    prepared = modeling.ml_prepare(_line(spark, sf).drop("l_discount"), "l_extendedprice", LINE_KEYS)
    model = modeling.estimators(False, 0, 1)["Linear Regression"].fit(prepared.assembled())
    row = [(float(model.coefficients[0]), float(model.intercept))]
    out = spark.createDataFrame(row, "slope double, intercept double")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


# Orders whose class two flags decide, and a number that a small column decides: any model must find them.
FLAGGED = View(
    "orders",
    [
        "o_orderkey",
        "o_orderkey % 3 = 0 AS is_a",
        "o_orderkey % 3 = 1 AS is_b",
        "o_totalprice",
        "CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind",
    ],
)
TWO_WAYS = View("orders", ["o_orderkey", "o_orderkey % 3 = 0 AS is_a", "o_totalprice", "CASE o_orderkey % 3 WHEN 0 THEN 'a' ELSE 'z' END AS kind"])
STEPPED = View("orders", ["o_orderkey", "CAST(o_orderkey % 20 AS DOUBLE) AS step", "CAST(o_orderkey % 20 AS DOUBLE) * 10.0 AS amount"])


def _split_sql(source: str, key: str, label: str = "") -> str:
    """The test rows of the exact split, by class if a label is given."""
    part = f"PARTITION BY {label}" if label else ""
    return f"""(SELECT *, row_number() OVER ({part} ORDER BY md5('42|' || {key}::VARCHAR), {key}) - 1
        < round(count(*) OVER ({part}) * 0.2) AS is_test FROM ({source}))"""


def _found(frame, measures):
    return frame.select(*[(F.round(m, 4) + 0.0).alias(m) for m in measures])


_CLASS = ["accuracy", "f1", "precision", "recall"]


def _flags_sql(view: View, rule: str) -> str:
    """How often the rule on the flags gives the class: all measures are that share if it is 1."""
    measures = ", ".join(f'round(avg((kind = {rule})::INT), 4) AS "{m}"' for m in _CLASS)
    return f"SELECT {measures} FROM {_split_sql(view.sql, 'o_orderkey', 'kind')} WHERE is_test"


_KIND = "CASE WHEN is_a THEN 'a' WHEN is_b THEN 'b' ELSE 'c' END"


@query("train_logistic", _flags_sql(FLAGGED, _KIND))
def _(spark, sf):
    return _found(_train(spark, sf, "Logistic Regression", FLAGGED, "kind").metrics, _CLASS)


@query("train_extra_trees", _flags_sql(FLAGGED, _KIND))
def _(spark, sf):
    """At the default size: 100 trees of up to 30 levels."""
    return _found(_train(spark, sf, "Extra Trees", FLAGGED, "kind").metrics, _CLASS)


@query("train_gbt", _flags_sql(TWO_WAYS, "CASE WHEN is_a THEN 'a' ELSE 'z' END"))
def _(spark, sf):
    """At the default size: 100 rounds."""
    return _found(_train(spark, sf, "Gradient Boosting", TWO_WAYS, "kind").metrics, _CLASS)


@query("train_gbt_classes", _flags_sql(FLAGGED, _KIND))
def _(spark, sf):
    """Three classes: one boosted model for each against the rest, of 3 rounds."""
    return _found(_train(spark, sf, "Gradient Boosting", FLAGGED, "kind", rounds=3).metrics, _CLASS)


@query(
    "train_random_forest",
    f"""SELECT round(1 - sum(pow(amount - step * 10, 2)) / (var_pop(amount) * count(*)), 4) AS r2, round(avg(abs(amount - step * 10)), 4) AS mae
        FROM {_split_sql(STEPPED.sql, "o_orderkey")} WHERE is_test""",
)
def _(spark, sf):
    return _found(_train(spark, sf, "Random Forest", STEPPED, "amount").metrics, ["r2", "mae"])


@query(
    "train_all",
    f"""WITH t AS (SELECT * FROM {_split_sql(TWO_WAYS.sql, "o_orderkey", "kind")} WHERE is_test),
    m AS (SELECT model, round(avg((kind = CASE WHEN is_a THEN 'a' ELSE 'z' END)::INT), 4) AS accuracy
          FROM t, (VALUES ('Random Forest'), ('Extra Trees'), ('Gradient Boosting'), ('Logistic Regression')) v(model) GROUP BY model)
    SELECT model, accuracy, model = (SELECT model FROM m ORDER BY accuracy DESC, model LIMIT 1) AS best FROM m""",
)
def _(spark, sf):
    """Four models of small size on one split, the best of them named; equals go by name."""
    trained = _train(spark, sf, None, TWO_WAYS, "kind", trees=5, rounds=3, max_depth=4)
    return trained.metrics.select("model", (F.round("accuracy", 4) + 0.0).alias("accuracy"), (F.col("model") == trained.best).alias("best"))


# Parts priced by size: regressions with closed forms.
PARTS = View("part", ["p_partkey", "p_size", "p_retailprice"])
PARTS_2 = View("part", ["p_partkey", "p_size", "p_partkey % 7 AS grp", "p_retailprice"])
_PARTS = _split_sql(PARTS.sql, "p_partkey")
_PARTS_LINE = f"""WITH p AS (SELECT * FROM {_PARTS}),
    r AS (SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS c FROM p WHERE NOT is_test)"""


def _parts(spark, sf, view=PARTS, **options):
    return _train(spark, sf, "Linear Regression", view, "p_retailprice", "p_partkey", **options)


@query(
    "model_predictions",
    f"{_PARTS_LINE} SELECT p_partkey, p_retailprice AS label, round(c + b * p_size, 4) AS prediction FROM p, r WHERE is_test",
)
def _(spark, sf):
    found = _parts(spark, sf).predictions["Linear Regression"]
    return found.select("p_partkey", "label", F.round("prediction", 4).alias("prediction"))


@query(
    "feature_importance",
    f"""WITH p AS (SELECT p_size AS x, grp AS z, p_retailprice AS y FROM {_split_sql(PARTS_2.sql, "p_partkey")} WHERE NOT is_test),
    s AS (SELECT var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM p),
    b AS (SELECT abs((xy * zz - zy * xz) / (xx * zz - xz * xz)) AS bx, abs((zy * xx - xy * xz) / (xx * zz - xz * xz)) AS bz FROM s)
    SELECT 'p_size' AS feature, round(bx / (bx + bz), 6) AS importance FROM b UNION ALL SELECT 'grp', round(bz / (bx + bz), 6) FROM b""",
)
def _(spark, sf):
    trained = _parts(spark, sf, PARTS_2)
    found = modeling.feature_importance(trained.models["Linear Regression"], trained.prepared)
    return found.withColumn("importance", F.round("importance", 6))


@query(
    "permutation_importance",
    f"""{_PARTS_LINE}, t AS (SELECT p_size AS x, p_retailprice AS y, row_number() OVER (ORDER BY md5('order42|' || p_partkey::VARCHAR), p_partkey) - 1 AS i,
            count(*) OVER () AS n FROM p WHERE is_test),
    base AS (SELECT 1 - sum(pow(y - c - b * x, 2)) / (var_pop(y) * count(*)) AS q FROM t, r),
    loss AS (SELECT k, (SELECT q FROM base) - (1 - sum(pow(a.y - c - b * o.x, 2)) / (var_pop(a.y) * count(*))) AS lost
        FROM t a, r, range(3) s(k), t o WHERE a.i = (o.i + 1 + (42 * 7919 + k * 104729) % (a.n - 1)) % a.n GROUP BY k)
    SELECT 'p_size' AS feature, round(avg(lost), 6) AS importance, round(stddev_pop(lost), 6) AS std FROM loss""",
)
def _(spark, sf):
    found = _parts(spark, sf, permute=True).permutation["Linear Regression"]
    return found.select("feature", *[F.round(c, 6).alias(c) for c in ("importance", "std")])


@query(
    "cross_validate",
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () // 5 AS s, count(*) OVER () % 5 AS e FROM ({PARTS.sql})),
    f AS (SELECT p_size AS x, p_retailprice AS y, (CASE WHEN i < e * (s + 1) THEN i // (s + 1) ELSE e + (i - e * (s + 1)) // s END)::INT AS fold FROM o),
    r AS (SELECT k::INT AS k, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM f, range(5) q(k) WHERE fold <> k GROUP BY k)
    SELECT fold, round(1 - sum(pow(y - any_c - any_b * x, 2)) / (var_pop(y) * count(*)), 6) AS score
    FROM (SELECT f.*, r.b AS any_b, r.c AS any_c FROM f JOIN r ON f.fold = r.k) GROUP BY fold""",
)
def _(spark, sf):
    found = _parts(spark, sf, run_cv=True).folds["Linear Regression"]
    return found.select("fold", F.round("score", 6).alias("score"))


@query(
    "partial_dependence",
    """WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
        min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT p::INT AS point, round(lo + p * ((hi - lo) / 49), 4) AS value, round(i + s * (lo + p * ((hi - lo) / 49)), 2) AS prediction
    FROM r, range(50) q(p)""",
)
def _(spark, sf):
    prepared = modeling.ml_prepare(_line(spark, sf).drop("l_discount"), "l_extendedprice", LINE_KEYS)
    model = modeling.estimators(False, 0, 1)["Linear Regression"].fit(prepared.assembled())
    found = modeling.partial_dependence(model, prepared.frame, prepared, "l_quantity")
    return found.select("point", F.round("value", 4).alias("value"), F.round("prediction", 2).alias("prediction"))


# --- many classes --------------------------------------------------------------------

# More than a thousand categories from sf0.01 on.
MANY = View("orders", ["o_orderkey", "'c' || CAST(o_orderkey % 1103 AS VARCHAR(10)) AS cat", "o_totalprice"])


@query(
    "ml_prepare_many",
    f"""WITH m AS ({MANY.sql}), k AS (SELECT DISTINCT cat FROM m), r AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS i FROM k),
    n AS (SELECT count(*) AS c FROM k)
    SELECT o_orderkey, o_totalprice AS label, (CASE WHEN i > 0 THEN 1 ELSE 0 END)::DOUBLE AS flags, (i * (i > 0)::INT)::DOUBLE AS place,
        (c - 1)::BIGINT AS features FROM m JOIN r ON m.cat = r.cat, n""",
)
def _(spark, sf):
    """A flag per category but the first: how many are set in a row, and which."""
    p = modeling.ml_prepare(MANY.df(spark, sf), "o_totalprice", ["o_orderkey"])
    found = p.assembled().select("o_orderkey", "label", vector_parts(F.col("features")).alias("v"))
    return found.select(
        "o_orderkey", "label", F.aggregate("v.values", F.lit(0.0), lambda a, b: a + b).alias("flags"),
        F.coalesce(F.get("v.indices", F.lit(0)) + 1, F.lit(0)).cast("double").alias("place"),
        F.col("v.size").cast("bigint").alias("features"),
    )


@query(
    "cv_folds_many",
    f"""WITH o AS (SELECT o_orderkey, cat, row_number() OVER (PARTITION BY cat ORDER BY o_orderkey) - 1 AS j,
            min(o_orderkey) OVER (PARTITION BY cat) AS first_key FROM ({MANY.sql})),
    c AS (SELECT cat, first_key, count(*) AS n FROM o GROUP BY 1, 2),
    s AS (SELECT cat, n, (coalesce(sum(n) OVER (ORDER BY first_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS st FROM c),
    f AS (SELECT cat, k, (SELECT count(*) FROM range(s.st, s.st + s.n) r(p) WHERE p % 5 = k) AS size FROM s, range(5) q(k)),
    u AS (SELECT cat, k, sum(size) OVER (PARTITION BY cat ORDER BY k) - size AS lo, sum(size) OVER (PARTITION BY cat ORDER BY k) AS hi FROM f)
    SELECT o.o_orderkey, u.k::INT AS fold FROM o JOIN u ON o.cat = u.cat AND o.j >= u.lo AND o.j < u.hi""",
)
def _(spark, sf):
    folded = modeling.cv_folds(MANY.df(spark, sf), ["o_orderkey"], 5, "cat")
    return folded.select("o_orderkey", "fold")


GUESSED_MANY = View(
    "orders", ["CAST(o_orderkey % 1103 AS DOUBLE) AS label", "CAST(o_orderkey % 1103 - o_orderkey % 2 AS DOUBLE) AS prediction"]
)


@query(
    "confusion_matrix_many",
    f"""WITH g AS ({GUESSED_MANY.sql}), v AS (SELECT label AS v FROM g UNION SELECT prediction FROM g),
    c AS (SELECT label, prediction, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT label, count(*) AS n FROM g GROUP BY 1)
    SELECT a.v AS label, sum(coalesce(c.n, 0))::BIGINT AS rows, count(*) AS cells, round(sum(coalesce(c.n, 0) / (coalesce(t.n, 0) + 1e-9)), 6) AS rate
    FROM v a CROSS JOIN v b LEFT JOIN c ON c.label = a.v AND c.prediction = b.v LEFT JOIN t ON t.label = a.v GROUP BY a.v""",
)
def _(spark, sf):
    full = modeling.confusion_matrix(GUESSED_MANY.df(spark, sf))
    return full.groupBy("label").agg(
        F.sum("count").alias("rows"), F.count(F.lit(1)).alias("cells"), F.round(F.sum("rate"), 6).alias("rate")
    )


# --- metrics -------------------------------------------------------------------------


@query(
    "classification_metrics",
    f"""WITH g AS ({GUESSED.sql}), n AS (SELECT count(*)::DOUBLE AS n FROM g),
    c AS (SELECT l.v, (SELECT count(*) FROM g WHERE label = l.v) AS support, (SELECT count(*) FROM g WHERE prediction = l.v) AS guesses,
        (SELECT count(*) FROM g WHERE label = l.v AND prediction = l.v) AS tp FROM (SELECT DISTINCT label AS v FROM g) l)
    SELECT round(sum(tp) / any_value(n), 6) AS accuracy, round(sum(support * 2.0 * tp / (support + guesses)) / any_value(n), 6) AS f1,
        round(sum(CASE WHEN guesses > 0 THEN support * tp / guesses::DOUBLE ELSE 0 END) / any_value(n), 6) AS "precision",
        round(sum(tp) / any_value(n), 6) AS recall FROM c, n""",
)
def _(spark, sf):
    found = modeling.classification_metrics(GUESSED.df(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "confusion_matrix",
    f"""WITH g AS ({GUESSED.sql}), v AS (SELECT label AS v FROM g UNION SELECT prediction FROM g)
    SELECT a.v AS label, b.v AS prediction, count(g.label) AS count,
        round(count(g.label) / ((SELECT count(*) FROM g WHERE label = a.v) + 1e-9), 6) AS rate
    FROM v a CROSS JOIN v b LEFT JOIN g ON g.label = a.v AND g.prediction = b.v GROUP BY a.v, b.v""",
)
def _(spark, sf):
    return modeling.confusion_matrix(GUESSED.df(spark, sf)).withColumn("rate", F.round("rate", 6))


_ROC = f"""WITH s AS ({SCORED.sql}), t AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM s),
    d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
    r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps FROM d),
    a AS (SELECT *, lag(tps) OVER w AS tp0, lead(tps) OVER w AS tp2, lag(fps) OVER w AS fp0, lead(fps) OVER w AS fp2 FROM r
          WINDOW w AS (ORDER BY score DESC))"""


@query(
    "roc_curve",
    _ROC
    + """ SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, NULL::DOUBLE AS threshold UNION ALL
    SELECT round(fps / n, 6), round(tps / p, 6), score FROM a, t
    WHERE tp0 IS NULL OR tp2 IS NULL OR tp2 - 2 * tps + tp0 <> 0 OR fp2 - 2 * fps + fp0 <> 0""",
)
def _(spark, sf):
    curve = modeling.roc_curve(SCORED.df(spark, sf))
    return curve.withColumns({"fpr": F.round("fpr", 6), "tpr": F.round("tpr", 6)})


@query("roc_auc", _ROC + " SELECT round(sum(neg * (2 * (tps - pos) + pos) / 2) / any_value(p * n), 6) AS auc FROM r, t")
def _(spark, sf):
    return modeling.roc_auc(SCORED.df(spark, sf)).withColumn("auc", F.round("auc", 6))


@query(
    "regression_metrics",
    f"""SELECT round(1 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)), 6) AS r2, round(avg(abs(label - prediction)), 4) AS mae,
        round(avg(pow(label - prediction, 2)), 1) AS mse, round(sqrt(avg(pow(label - prediction, 2))), 4) AS rmse FROM ({FITTED_LINE.sql})""",
)
def _(spark, sf):
    found = modeling.regression_metrics(FITTED_LINE.df(spark, sf))
    return found.select(
        F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("mse", 1).alias("mse"), F.round("rmse", 4).alias("rmse")
    )


@query(
    "best_model",
    f"""WITH g AS ({GUESSED.sql}), m AS (SELECT 'half price' AS model, avg((label = prediction)::INT) AS accuracy FROM g
        UNION ALL SELECT 'always 2', avg((label = 2)::INT) FROM g)
    SELECT model, round(accuracy, 6) AS accuracy FROM m ORDER BY accuracy DESC, model LIMIT 1""",
)
def _(spark, sf):
    guesses = GUESSED.df(spark, sf)
    rivals = {"half price": guesses, "always 2": guesses.withColumn("prediction", F.lit(2.0))}
    metrics = None
    for name, df in rivals.items():
        row = modeling.classification_metrics(df).withColumn("model", F.lit(name))
        metrics = row if metrics is None else metrics.unionByName(row)
    return modeling.best_model(metrics, "accuracy").withColumn("accuracy", F.round("accuracy", 6))
