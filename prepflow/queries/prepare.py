"""Cleaning, feature engineering, replay and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepflow.functions.vectors import vector_parts
from prepflow.operators import cleaning, features, profile
from prepflow.operators.cleaning import CleanSpec, ColumnRule
from prepflow.operators.features import FeatureSpec
from prepflow.plans.report import report_tables, write_report
from prepflow.plans.spec import FittedPrep, PrepSpec
from prepflow.queries.describe import EVENTS_PROFILE, _ready_sql, _table_sql, fence_sql
from prepflow.queries.registry import COLUMNS, EVENTS_N, ORDERS_D, ORDERS_N, View, query, table
from prepflow.session import scratch_path

# A small-valued view of the events with copies, gaps and outliers.
DIRTY = View(
    "events",
    [
        "event_type",
        "user_id % 40 AS grp",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value, 0) END AS amount",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind",
    ],
)
DIRTY_COLUMNS = ["event_type", "grp", "amount", "kind"]


def _others(columns, changed):
    return ", ".join(c for c in columns if c != changed)


def _orders_sql(changed: str, expr: str) -> str:
    return f"SELECT {_others(COLUMNS['orders'], changed)}, {expr} AS {changed} FROM ({ORDERS_N.sql})"


# --- cleaning ------------------------------------------------------------------------


@query("dedup", f"SELECT DISTINCT * FROM ({ORDERS_D.sql})")
def _(spark, sf):
    return cleaning.dedup(ORDERS_D.df(spark, sf))


@query(
    "impute_mean",
    _orders_sql("o_totalprice", f"round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM ({ORDERS_N.sql}))), 4)"),
)
def _(spark, sf):
    out = cleaning.impute(ORDERS_N.df(spark, sf), "o_totalprice", "mean")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "impute_median",
    _orders_sql(
        "o_totalprice",
        f"round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM ({ORDERS_N.sql}))), 6)",
    ),
)
def _(spark, sf):
    out = cleaning.impute(ORDERS_N.df(spark, sf), "o_totalprice", "median")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "impute_mode",
    _orders_sql(
        "o_orderpriority",
        f"""coalesce(o_orderpriority, (SELECT o_orderpriority FROM ({ORDERS_N.sql}) WHERE o_orderpriority IS NOT NULL
            GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1))""",
    ),
)
def _(spark, sf):
    return cleaning.impute(ORDERS_N.df(spark, sf), "o_orderpriority", "mode")


_EVENT_REST = "event_id, event_type"


@query(
    "impute_ffill",
    f"""SELECT {_EVENT_REST}, last_value(value IGNORE NULLS) OVER
        (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM ({EVENTS_N.sql})""",
)
def _(spark, sf):
    return cleaning.impute(EVENTS_N.df(spark, sf), "value", "ffill", order_by=["ts", "event_id"]).drop("ts")


@query(
    "impute_bfill",
    f"""SELECT {_EVENT_REST}, first_value(value IGNORE NULLS) OVER
        (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM ({EVENTS_N.sql})""",
)
def _(spark, sf):
    return cleaning.impute(EVENTS_N.df(spark, sf), "value", "bfill", order_by=["ts", "event_id"]).drop("ts")


@query("impute_zero", _orders_sql("o_totalprice", "coalesce(o_totalprice, 0)"))
def _(spark, sf):
    return cleaning.impute(ORDERS_N.df(spark, sf), "o_totalprice", "zero")


@query("impute_custom", _orders_sql("o_orderpriority", "coalesce(o_orderpriority, '9-UNKNOWN')"))
def _(spark, sf):
    return cleaning.impute(ORDERS_N.df(spark, sf), "o_orderpriority", "custom", "9-UNKNOWN")


@query("drop_null_rows", f"SELECT * FROM ({ORDERS_N.sql}) WHERE o_orderdate IS NOT NULL")
def _(spark, sf):
    return cleaning.drop_null_rows(ORDERS_N.df(spark, sf), "o_orderdate")


_VALUE_FENCE = fence_sql("events").replace("{c}", "value")


@query(
    "outlier_cap",
    f"SELECT event_id, user_id, event_type, round(greatest(least(value, hi), lo), 6) AS value FROM events, {_VALUE_FENCE}",
)
def _(spark, sf):
    out = cleaning.outlier_cap(table(spark, sf, "events"), "value")
    return out.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query(
    "outlier_remove",
    f"""SELECT event_id, event_type, value FROM ({EVENTS_N.sql}), {fence_sql(f"({EVENTS_N.sql})").replace("{c}", "value")}
        WHERE value IS NULL OR value BETWEEN lo AND hi""",
)
def _(spark, sf):
    return cleaning.outlier_remove(EVENTS_N.df(spark, sf), "value").drop("ts")


CHAIN = CleanSpec(
    True,
    {
        "kind": ColumnRule("drop"),
        "amount": ColumnRule("median", "remove"),
        "grp": ColumnRule("none", "cap"),
    },
)
_CHAIN_CTE = f"""WITH raw AS ({DIRTY.sql}), d AS (SELECT DISTINCT * FROM raw),
    k AS (SELECT * FROM d WHERE kind IS NOT NULL),
    m AS (SELECT event_type, grp, coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM k)) AS amount, kind FROM k),
    fa AS (SELECT * FROM {fence_sql("m").replace("{c}", "amount")}),
    r AS (SELECT m.* FROM m, fa WHERE amount BETWEEN lo AND hi),
    fg AS (SELECT * FROM {fence_sql("r").replace("{c}", "grp")}),
    done AS (SELECT event_type, greatest(least(grp::DOUBLE, hi), lo) AS grp, amount, kind FROM r, fg)"""


@query("clean_chain", f"{_CHAIN_CTE} SELECT event_type, round(grp, 6)::DOUBLE AS grp, round(amount, 6) AS amount, kind FROM done")
def _(spark, sf):
    out, _log = cleaning.apply_cleaning(DIRTY.df(spark, sf), CHAIN)
    return out.select(
        "event_type", F.round(F.col("grp").cast("double"), 6).alias("grp"), F.round("amount", 6).alias("amount"), "kind"
    )


# Every fifth amount is NaN in one engine and missing in the other: copies all the same.
_WITH_NAN = "CASE WHEN event_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 0) END AS amount"
DIRTY_NAN = View("events", ["event_type", _WITH_NAN])


@query(
    "clean_chain_nan",
    f"""WITH r AS (SELECT event_type, CASE WHEN isnan(amount) THEN NULL ELSE amount END AS amount FROM ({DIRTY_NAN.sql})), d AS (SELECT DISTINCT * FROM r)
    SELECT event_type, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM d)), 6) AS amount,
        (SELECT count(*) FROM r) - (SELECT count(*) FROM d) AS copies FROM d""",
)
def _(spark, sf):
    spec = CleanSpec(True, {"amount": ColumnRule("median")})
    out, log = cleaning.apply_cleaning(DIRTY_NAN.df(spark, sf), spec)
    copies = log.where("action = 'remove_duplicates'").select(F.col("n_affected").alias("copies"))
    return out.select("event_type", F.round("amount", 6).alias("amount")).join(F.broadcast(copies))


@query(
    "changelog",
    f"""{_CHAIN_CTE} SELECT * FROM (
        SELECT 'remove_duplicates' AS action, (SELECT count(*) FROM raw) - (SELECT count(*) FROM d) AS n_affected
        UNION ALL SELECT 'drop_null_rows', (SELECT count(*) FROM d WHERE kind IS NULL)
        UNION ALL SELECT 'fill_median', (SELECT count(*) FROM k WHERE amount IS NULL)
        UNION ALL SELECT 'remove_outliers', (SELECT count(*) FROM m) - (SELECT count(*) FROM r)
        UNION ALL SELECT 'cap_outliers', (SELECT count(*) FROM r, fg WHERE grp < lo OR grp > hi)) WHERE n_affected > 0""",
)
def _(spark, sf):
    return cleaning.apply_cleaning(DIRTY.df(spark, sf), CHAIN)[1].select("action", "n_affected")


@query(
    "cleaning_diff",
    f"""{_CHAIN_CTE},
    b AS (SELECT count(*) AS n, sum((amount IS NULL)::INT + (kind IS NULL)::INT)::BIGINT AS k FROM raw),
    a AS (SELECT count(*) AS n, sum((amount IS NULL)::INT + (kind IS NULL)::INT)::BIGINT AS k FROM done),
    db AS (SELECT (sum(c - 1))::BIGINT AS x FROM (SELECT count(*) AS c FROM raw GROUP BY ALL)),
    da AS (SELECT (sum(c - 1))::BIGINT AS x FROM (SELECT count(*) AS c FROM (SELECT event_type, grp, amount, kind FROM done)
           GROUP BY event_type, grp, amount, kind))
    SELECT b.n AS rows_before, a.n AS rows_after, b.n - a.n AS rows_removed, b.k AS nulls_before, a.k AS nulls_after,
        b.k - a.k AS nulls_removed, db.x AS dups_before, da.x AS dups_after FROM a, b, da, db""".replace(
        "(SELECT count(*) AS c FROM raw GROUP BY ALL)",
        "(SELECT count(*) AS c FROM raw GROUP BY event_type, grp, amount, kind)",
    ),
)
def _(spark, sf):
    before = DIRTY.df(spark, sf)
    return cleaning.cleaning_diff(before, cleaning.apply_cleaning(before, CHAIN)[0])


_N_FENCE = fence_sql(f"({EVENTS_N.sql})")


@query(
    "auto_clean_config",
    f"""SELECT 'event_id' AS "column", 'none' AS null_strategy, 'keep' AS outlier_strategy
    UNION ALL SELECT 'ts', 'none', 'keep' UNION ALL SELECT 'event_type', 'none', 'keep'
    UNION ALL SELECT 'value', CASE WHEN count(*) = count(value) THEN 'none' WHEN abs(skewness(value)) > 1 THEN 'median' ELSE 'mean' END,
        CASE WHEN count(*) FILTER (WHERE value < lo OR value > hi)::DOUBLE / count(*) * 100 > 0.5 THEN 'cap' ELSE 'keep' END
        FROM ({EVENTS_N.sql}), {_N_FENCE.replace("{c}", "value")}""",
)
def _(spark, sf):
    return cleaning.auto_clean_config(profile.profile(EVENTS_N.df(spark, sf)))


# --- features ------------------------------------------------------------------------


@query(
    "auto_feature_config",
    f"""SELECT 'o_orderkey' AS "column", 'scaling' AS step, 'standard' AS method UNION ALL SELECT 'o_custkey', 'scaling', 'standard'
    UNION ALL SELECT 'o_totalprice', 'scaling', 'standard'
    UNION ALL SELECT 'o_orderdate', 'datetime', 'year,month,day,dayofweek,quarter'
    UNION ALL SELECT 'o_orderstatus', 'encoding', CASE WHEN count(DISTINCT o_orderstatus) BETWEEN 3 AND 8 THEN 'onehot' ELSE 'label' END FROM orders
    UNION ALL SELECT 'o_orderpriority', 'encoding', CASE WHEN count(DISTINCT o_orderpriority) BETWEEN 3 AND 8 THEN 'onehot' ELSE 'label' END FROM orders""",
)
def _(spark, sf):
    return features.auto_feature_config(profile.profile(table(spark, sf, "orders")))


_PARTS_SQL = {
    "year": "year({c})", "month": "month({c})", "day": "day({c})", "dayofweek": "isodow({c}) - 1",
    "hour": "hour({c})", "minute": "minute({c})", "quarter": "quarter({c})", "weekofyear": "week({c})",
}


def _parts(column: str, wanted) -> str:
    return ", ".join(f"({_PARTS_SQL[p].replace('{c}', column)})::INT AS {column}_{p}" for p in wanted)


@query("datetime_parts", f"SELECT event_id, {_parts('ts', _PARTS_SQL)} FROM events")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts")
    return features.apply_features(df, FeatureSpec(datetime={"ts": list(_PARTS_SQL)}))[0]


@query(
    "encode_label",
    _orders_sql("o_orderpriority", "dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1"),
)
def _(spark, sf):
    return features.apply_features(ORDERS_N.df(spark, sf), FeatureSpec(encoding={"o_orderpriority": "label"}))[0]


@query(
    "encode_label_many",
    "SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_name, 'nan')) - 1 AS c_name FROM customer",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return features.apply_features(df, FeatureSpec(encoding={"c_name": "label"}))[0]


@query(
    "encode_onehot_many",
    """WITH o AS (SELECT o_orderkey, 'c' || (o_orderkey % 1103)::VARCHAR AS cat FROM orders), k AS (SELECT DISTINCT cat FROM o),
    r AS (SELECT cat, row_number() OVER (ORDER BY cat) AS i FROM k)
    SELECT o_orderkey, 1::BIGINT AS flags, i::BIGINT AS place, (SELECT count(*) FROM k) AS columns FROM o JOIN r ON o.cat = r.cat""",
)
def _(spark, sf):
    """More than a thousand flags in one vector: how many are set in a row, and which."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "concat('c', o_orderkey % 1103) AS cat")
    return _flags_set(df, "cat", "o_orderkey")


def _flags_set(df, name, *keys):
    """What the sparse vector of a one-hot encoding holds; ``place`` is counted from 1."""
    out = features.apply_features(df, FeatureSpec(encoding={name: "onehot"}))[0]
    v = vector_parts(F.col(f"{name}_onehot"))
    return out.select(*keys, v.alias("v")).select(
        *keys,
        F.aggregate("v.values", F.lit(0.0), lambda a, b: a + b).cast("bigint").alias("flags"),
        (F.get("v.indices", F.lit(0)) + 1).cast("bigint").alias("place"),
        F.col("v.size").cast("bigint").alias("columns"),
    )


@query(
    "encode_onehot_rows",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_linenumber < 7 THEN l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR END AS cat FROM lineitem),
    k AS (SELECT cat, row_number() OVER (ORDER BY cat) AS i FROM (SELECT DISTINCT cat FROM l WHERE cat IS NOT NULL))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (i IS NOT NULL)::BIGINT AS flags, i::BIGINT AS place,
        (SELECT count(*) FROM k)::BIGINT AS columns FROM l LEFT JOIN k ON l.cat = k.cat""",
)
def _(spark, sf):
    """About as many classes as rows, and missing values: a vector that wide with at most one flag in it."""
    cat = "CASE WHEN l_linenumber < 7 THEN concat(l_orderkey, '-', l_linenumber) END AS cat"
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return _flags_set(table(spark, sf, "lineitem").selectExpr(*keys, cat), "cat", *keys)


@query(
    "encode_ordinal_many",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS c_name FROM customer)
    SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN dense_rank() OVER (ORDER BY c_name NULLS LAST) - 1 END AS c_name FROM c""",
)
def _(spark, sf):
    """Codes in a table that is joined, as for any number of classes; missing stays missing."""
    df = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS c_name")
    return features.apply_features(df, FeatureSpec(encoding={"c_name": "ordinal"}), local_classes=0)[0]


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "encode_onehot",
    f"SELECT {_others(COLUMNS['orders'], 'o_orderpriority')}, "
    + ", ".join(f"""coalesce((o_orderpriority = '{v}')::INT, 0) AS "o_orderpriority_{v}" """ for v in _PRIORITIES)
    + f" FROM ({ORDERS_N.sql})",
)
def _(spark, sf):
    return features.apply_features(ORDERS_N.df(spark, sf), FeatureSpec(encoding={"o_orderpriority": "onehot"}))[0]


@query(
    "encode_ordinal",
    _orders_sql(
        "o_orderpriority",
        "CASE WHEN o_orderpriority IS NOT NULL THEN dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1 END",
    ),
)
def _(spark, sf):
    return features.apply_features(ORDERS_N.df(spark, sf), FeatureSpec(encoding={"o_orderpriority": "ordinal"}))[0]


_SCALED = {
    "standard": "(o_totalprice - (SELECT avg(o_totalprice) FROM s)) / (SELECT stddev_pop(o_totalprice) FROM s)",
    "minmax": "(o_totalprice - (SELECT min(o_totalprice) FROM s)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM s)",
    "robust": """(o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM s))
        / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM s)""",
}


def _scale_query(method: str):
    @query(
        f"scale_{method}",
        f"WITH s AS ({ORDERS_N.sql}) SELECT o_orderkey, round({_SCALED[method]}, 6) + 0.0 AS o_totalprice FROM s",
    )
    def _(spark, sf):
        df = ORDERS_N.df(spark, sf).select("o_orderkey", "o_totalprice")
        out = features.apply_features(df, FeatureSpec(scaling={"o_totalprice": method}))[0]
        return out.withColumn("o_totalprice", F.round("o_totalprice", 6) + 0.0)


for _method in _SCALED:
    _scale_query(_method)


@query(
    "bulk_scale",
    """SELECT c_name, c_mktsegment, """
    + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM customer))::DOUBLE / (SELECT max({c}) - min({c}) FROM customer), 6) AS {c}"
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    )
    + " FROM customer",
)
def _(spark, sf):
    out = features.bulk_scale(table(spark, sf, "customer"), "minmax")
    return out.withColumns({c: F.round(c, 6) for c in ("c_custkey", "c_nationkey", "c_acctbal")})


@query("drop_columns", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def _(spark, sf):
    spec = FeatureSpec(drop_cols=["p_size", "p_retailprice", "p_no_such_column"])
    return features.apply_features(table(spark, sf, "part"), spec)[0]


def _customer(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal")


@query(
    "log_transform",
    """SELECT c_custkey, c_acctbal, round(ln(1 + c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0
        THEN -min(c_acctbal) + 1e-6 ELSE 0 END FROM customer)), 6) AS c_acctbal_log FROM customer""",
)
def _(spark, sf):
    out = features.apply_features(_customer(spark, sf), FeatureSpec(log_transform=["c_acctbal"]))[0]
    return out.withColumn("c_acctbal_log", F.round("c_acctbal_log", 6))


@query(
    "sqrt_transform",
    """SELECT c_custkey, c_acctbal, round(sqrt(c_acctbal + (SELECT greatest(0, -min(c_acctbal)) FROM customer)), 6) AS c_acctbal_sqrt
       FROM customer""",
)
def _(spark, sf):
    out = features.apply_features(_customer(spark, sf), FeatureSpec(sqrt_transform=["c_acctbal"]))[0]
    return out.withColumn("c_acctbal_sqrt", F.round("c_acctbal_sqrt", 6))


@query("square_transform", "SELECT c_custkey, c_acctbal, round(c_acctbal * c_acctbal, 2) AS c_acctbal_sq FROM customer")
def _(spark, sf):
    out = features.apply_features(_customer(spark, sf), FeatureSpec(square_transform=["c_acctbal"]))[0]
    return out.withColumn("c_acctbal_sq", F.round("c_acctbal_sq", 2))


@query(
    "interaction",
    "SELECT l_quantity, l_extendedprice, round(l_quantity * l_extendedprice, 2) AS l_quantity_x_l_extendedprice FROM lineitem",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    out = features.apply_features(df, FeatureSpec(interaction_terms=[("l_quantity", "l_extendedprice")]))[0]
    return out.withColumn("l_quantity_x_l_extendedprice", F.round("l_quantity_x_l_extendedprice", 2))


@query(
    "formula",
    """SELECT l_quantity, l_extendedprice, l_discount, round(l_extendedprice * (1 - l_discount) / (l_quantity + 0.337), 6) AS unit_price,
        l_quantity > 10 AND l_discount <= 0.05 AS big_plain, round(sqrt(l_quantity) + pow(l_discount, 2), 6) AS mixed FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    spec = FeatureSpec(
        custom_formulas=[
            {"name": "unit_price", "formula": "l_extendedprice * (1 - l_discount) / (l_quantity + 0.337)"},
            {"name": "big_plain", "formula": "l_quantity > 10 & l_discount <= 0.05"},
            {"name": "mixed", "formula": "sqrt(l_quantity) + l_discount ** 2"},
        ]
    )
    out = features.apply_features(df, spec)[0]
    return out.withColumns({c: F.round(c, 6) for c in ("unit_price", "mixed")})


_BIG = "o_orderkey + 9007199254740992"


@query(
    "formula_integers",
    f"""SELECT o_orderkey, {_BIG} > 9007199254740995 AS after, {_BIG} = 9007199254740993 AS same, big <> o_custkey AS other
        FROM (SELECT o_orderkey, o_custkey, {_BIG} AS big FROM orders)""",
)
def _(spark, sf):
    """Keys beyond 2^53, which doubles do not tell apart."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", f"{_BIG} AS big")
    wanted = {"after": "big > 9007199254740995", "same": "big == 9007199254740993", "other": "big != o_custkey"}
    spec = FeatureSpec(custom_formulas=[features.Formula(n, f) for n, f in wanted.items()])
    return features.apply_features(df, spec)[0].drop("o_custkey", "big")


def _quantile_bins(column: str, source: str, bins: int) -> str:
    """Bin codes from distinct inner edges, right-closed."""
    points = ", ".join(f"quantile_cont({column}, {i / bins!r})" for i in range(bins + 1))
    return f"""(SELECT list_sort(list_distinct([{points}])) AS e FROM {source})"""


def _code(column: str) -> str:
    return f"len(list_filter(e[2:len(e) - 1], lambda x : {column} > x))::VARCHAR"


@query(
    "bin_quantile",
    f"""SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice IS NOT NULL THEN {_code("o_totalprice")} END AS o_totalprice_binned
        FROM ({ORDERS_N.sql}), {_quantile_bins("o_totalprice", f"({ORDERS_N.sql})", 5)}""",
)
def _(spark, sf):
    df = ORDERS_N.df(spark, sf).select("o_orderkey", "o_totalprice")
    return features.apply_features(df, FeatureSpec(binning=[{"col": "o_totalprice", "bins": 5}]))[0]


@query(
    "bin_uniform",
    """SELECT l_quantity, l_extendedprice, ("""
    + " + ".join(
        f"(l_extendedprice > lo + {i} * ((hi - lo) / 6))::INT" for i in range(1, 6)
    )
    + """)::VARCHAR AS l_extendedprice_binned FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    spec = FeatureSpec(binning=[{"col": "l_extendedprice", "bins": 6, "strategy": "uniform"}])
    return features.apply_features(df, spec)[0]


FEATURES = FeatureSpec(
    datetime={"o_orderdate": ["year", "quarter", "dayofweek"]},
    encoding={"o_orderpriority": "label", "o_orderstatus": "ordinal"},
    scaling={"o_totalprice": "standard", "o_custkey": "robust"},
    drop_cols=["o_custkey"],
    square_transform=["o_totalprice"],
    custom_formulas=[{"name": "mix", "formula": "o_totalprice_sq + o_orderdate_quarter"}],
    binning=[{"col": "o_totalprice", "bins": 4}],
)


def _features_sql(base: str) -> str:
    return f"""WITH b AS ({base}),
    s AS (SELECT o_orderkey, {_parts("o_orderdate", ["year", "quarter", "dayofweek"])},
            dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS o_orderpriority,
            dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
            (o_totalprice - (SELECT avg(o_totalprice) FROM b)) / (SELECT stddev_pop(o_totalprice) FROM b) AS o_totalprice FROM b)
    SELECT o_orderkey, o_orderdate_year, o_orderdate_quarter, o_orderdate_dayofweek, o_orderpriority, o_orderstatus,
        round(o_totalprice, 6) + 0.0 AS o_totalprice, round(o_totalprice * o_totalprice, 6) AS o_totalprice_sq,
        round(o_totalprice * o_totalprice + o_orderdate_quarter, 6) AS mix,
        CASE WHEN o_totalprice IS NOT NULL THEN {_code("o_totalprice")} END AS o_totalprice_binned
    FROM s, {_quantile_bins("o_totalprice", "s", 4)}"""


def _engineered(df):
    return df.withColumns(
        {
            "o_totalprice": F.round("o_totalprice", 6) + 0.0,
            "o_totalprice_sq": F.round("o_totalprice_sq", 6),
            "mix": F.round("mix", 6),
        }
    )


@query("feature_chain", _features_sql(ORDERS_N.sql))
def _(spark, sf):
    return _engineered(features.apply_features(ORDERS_N.df(spark, sf), FEATURES)[0])


# --- replay and report ---------------------------------------------------------------

PLAN = PrepSpec(
    CleanSpec(
        True,
        {
            "o_totalprice": ColumnRule("mean"),
            "o_orderpriority": ColumnRule("mode"),
            "o_orderdate": ColumnRule("drop"),
        },
    ),
    FEATURES,
)
_PLAN_CLEAN = f"""SELECT o_orderkey, o_custkey, o_orderstatus,
    coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM ({ORDERS_N.sql}))) AS o_totalprice, o_orderdate,
    coalesce(o_orderpriority, (SELECT o_orderpriority FROM ({ORDERS_N.sql}) WHERE o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority
    FROM ({ORDERS_N.sql}) WHERE o_orderdate IS NOT NULL"""


@query("spec_replay", _features_sql(_PLAN_CLEAN))
def _(spark, sf):
    df = ORDERS_N.df(spark, sf)
    path = scratch_path(spark, "plan")
    PLAN.fit(df).save(spark, path)
    return _engineered(FittedPrep.load(spark, path).transform(df))


_SKEW = f"(SELECT CASE WHEN abs(skewness(o_totalprice)) > 1 THEN 'median' ELSE 'mean' END FROM ({ORDERS_N.sql}))"


def _missing(column: str) -> str:
    return f"(SELECT count(*) > count({column}) FROM ({ORDERS_N.sql}))"


def _far(column: str) -> str:
    return f"""(SELECT count(*) FILTER (WHERE {column} < lo OR {column} > hi)::DOUBLE / count(*) * 100 > 0.5
        FROM ({ORDERS_N.sql}), {fence_sql(f"({ORDERS_N.sql})").replace("{c}", column)})"""


_STEPS = [
    ("clean", None, "'remove_duplicates'", "true"),
    ("clean", "o_orderkey", "'outliers: cap'", _far("o_orderkey")),
    ("clean", "o_custkey", "'outliers: cap'", _far("o_custkey")),
    ("clean", "o_totalprice", f"'nulls: ' || {_SKEW}", _missing("o_totalprice")),
    ("clean", "o_totalprice", "'outliers: cap'", _far("o_totalprice")),
    ("clean", "o_orderdate", "'nulls: drop'", _missing("o_orderdate")),
    ("clean", "o_orderpriority", "'nulls: mode'", _missing("o_orderpriority")),
    *[
        ("features", c, f"'{a}'", "true")
        for c, a in (
            ("o_orderdate", "datetime: year,quarter,dayofweek"), ("o_orderpriority", "encode: label"),
            ("o_orderstatus", "encode: ordinal"), ("o_totalprice", "scale: standard"), ("o_custkey", "scale: robust"),
            ("o_custkey", "drop"), ("o_totalprice", "square"), ("mix", "formula: o_totalprice_sq + o_orderdate_quarter"),
            ("o_totalprice", "bin: quantile"),
        )
    ],
]


@query(
    "spec_steps",
    'SELECT row_number() OVER (ORDER BY place) AS step, stage, "column", action FROM ('
    + " UNION ALL ".join(
        f"""SELECT {i} AS place, '{stage}' AS stage, {f"'{c}'" if c else "NULL::VARCHAR"} AS "column", {action} AS action WHERE {when}"""
        for i, (stage, c, action, when) in enumerate(_STEPS)
    )
    + ")",
)
def _(spark, sf):
    auto = PrepSpec(cleaning.auto_clean_spec(profile.profile(ORDERS_N.df(spark, sf))), FEATURES)
    return auto.steps(spark)


def _report(spark, sf, section: str):
    """Write one section of the report on the events, read it back."""
    path = scratch_path(spark, "report")
    write_report(report_tables(table(spark, sf, "events"), "event_type", sections=[section]), path)
    return spark.read.parquet(f"{path}/{section}")


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("report_overview", _table_sql("SELECT * FROM events", _EVENT_COLUMNS))
def _(spark, sf):
    return _report(spark, sf, "overview")


@query(
    "report_columns",
    f"""SELECT "column", kind, null_count, unique_count, mean, skewness, outlier_count, top_value FROM ({EVENTS_PROFILE})""",
)
def _(spark, sf):
    return _report(spark, sf, "columns").select(
        "column", "kind", "null_count", "unique_count", F.round("mean", 4).alias("mean"), "skewness",
        "outlier_count", "top_value",
    )


_EVENT_READY = _ready_sql("SELECT * FROM events", _EVENT_COLUMNS, ["event_id", "user_id", "value"], "event_type")


@query(
    "report_readiness",
    f"SELECT round(completeness, 4) AS completeness, round(encoding, 4) AS encoding, round(class_balance, 4) AS class_balance, n_rows FROM ({_EVENT_READY})",
)
def _(spark, sf):
    return _report(spark, sf, "readiness").select("completeness", "encoding", "class_balance", "n_rows")
