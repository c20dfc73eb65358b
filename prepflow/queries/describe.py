"""Sources, column typing, profile, quality rules and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepflow.operators import cleaning, features, frequency, profile, quantiles, readiness, scan, types
from prepflow.operators.features import FeatureSpec
from prepflow.queries.registry import (
    COLUMNS,
    DOCS_L,
    LINE_X,
    NUMERIC,
    ORDERS_D,
    ORDERS_N,
    View,
    docs_labels,
    each,
    pct_sql,
    query,
    table,
)
from prepflow.session import scratch_path
from prepflow.sources import tables

# --- sources -------------------------------------------------------------------------


@query("read_table", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _(spark, sf):
    df = tables.read_table(spark, f"{sf.rstrip('/')}/nation.parquet")
    return df.selectExpr("cast(n_nationkey as bigint) n_nationkey", "n_name", "cast(n_regionkey as bigint) n_regionkey")


@query("read_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    return tables.read_parquet(spark, f"{sf.rstrip('/')}/events.parquet").select(
        "event_id", "user_id", "event_type", "value"
    )


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    tables.write_csv(table(spark, sf, "customer"), path)
    return tables.read_table(spark, path)


@query(
    "write_csv",
    f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM ({ORDERS_N.sql})",
)
def _(spark, sf):
    path = scratch_path(spark, "orders") + ".csv"
    tables.write_csv(ORDERS_N.df(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return tables.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query("csv_round_trip", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "documents") + ".csv"
    tables.write_csv(table(spark, sf, "documents"), path)
    return tables.read_csv(spark, path, multi_line=True)


@query(
    "current_stage",
    f"""WITH c AS (SELECT DISTINCT * FROM ({ORDERS_N.sql}) WHERE o_orderpriority IS NOT NULL)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, round(o_totalprice * o_totalprice, 2) AS o_totalprice_sq FROM c""",
)
def _(spark, sf):
    """Raw, cleaned, engineered; the latest is written and read back."""
    raw = ORDERS_N.df(spark, sf).drop("o_orderdate")
    cleaned = cleaning.apply_cleaning(raw, cleaning.CleanSpec(True, {"o_orderpriority": cleaning.ColumnRule("drop")}))[0]
    engineered = features.apply_features(cleaned, features.FeatureSpec(square_transform=["o_totalprice"]))[0]
    path = scratch_path(spark, "stage") + ".csv"
    tables.write_csv(tables.current_stage(raw, cleaned, engineered), path)
    out = tables.read_table(spark, path)
    return out.withColumn("o_totalprice_sq", F.round("o_totalprice_sq", 2))


@query("read_json", "SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice FROM part")
def _(spark, sf):
    path = scratch_path(spark, "part") + ".json"
    table(spark, sf, "part").write.json(path)
    return tables.read_table(spark, path).select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query(
    "preview_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50",
)
def _(spark, sf):
    return tables.preview_rows(table(spark, sf, "orders"), ["o_orderkey"], 50).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )


_SAMPLED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(
    "sample_values",
    each(
        _SAMPLED,
        f"""SELECT '{{c}}' AS "column", value, "rank"::BIGINT AS "rank" FROM (
            SELECT {{c}}::VARCHAR AS value,
                   row_number() OVER (ORDER BY md5('|' || o_orderkey::VARCHAR), {{c}}::VARCHAR) AS "rank"
            FROM ({ORDERS_N.sql}) WHERE {{c}} IS NOT NULL) WHERE "rank" <= 5""",
    ),
)
def _(spark, sf):
    drawn = tables.sample_values(ORDERS_N.df(spark, sf), ["o_orderkey"], _SAMPLED, 5)
    return drawn.select("column", "value", F.col("rank").cast("bigint").alias("rank"))


# --- column typing -------------------------------------------------------------------

_TEXTS = ["text", "lang", "source"]


@query(
    "column_types",
    each(["doc_id", "n_chars"], """SELECT '{c}' AS "column", 'numeric' AS kind""")
    + "\nUNION ALL\n"
    + each(
        _TEXTS,
        """SELECT '{c}' AS "column",
           CASE WHEN (SELECT count(*) > 0 AND count(*) = count(TRY_CAST(v AS TIMESTAMP)) FROM
                 (SELECT {c} AS v FROM documents WHERE {c} IS NOT NULL)) THEN 'datetime'
                WHEN (SELECT avg(length({c})) FROM documents) > 80 THEN 'text' ELSE 'categorical' END AS kind""",
    ),
)
def _(spark, sf):
    return types.column_types(table(spark, sf, "documents"))


@query("type_distribution", "SELECT kind, count(*) AS columns FROM (" + each(
    [c for c in COLUMNS["orders"]],
    """SELECT CASE WHEN typeof(any_value({c})) IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric'
       WHEN typeof(any_value({c})) LIKE 'TIMESTAMP%' THEN 'datetime'
       WHEN avg(length({c}::VARCHAR)) > 80 THEN 'text' ELSE 'categorical' END AS kind FROM orders""",
) + ") GROUP BY kind")
def _(spark, sf):
    return types.type_distribution(table(spark, sf, "orders"))


# Text dates; text dates of which one late row is none; other texts.
_DATED = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
    CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS nearly,
    o_orderpriority FROM orders"""


def _dated(spark, sf):
    orders = table(spark, sf, "orders")
    last = F.broadcast(orders.agg(F.max("o_orderkey").alias("last")))  # one row
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.join(last, F.col("o_orderkey") == F.col("last"), "left").select(
        "o_orderkey", day.alias("day_text"), F.when(F.col("last").isNull(), day).otherwise("unknown").alias("nearly"),
        "o_orderpriority",
    )


@query(
    "datetime_probe",
    each(
        ["day_text", "nearly", "o_orderpriority"],
        f"""SELECT '{{c}}' AS "column", count(*) AS probed, count(TRY_CAST(v AS TIMESTAMP)) AS parsed,
            count(*) = count(TRY_CAST(v AS TIMESTAMP)) AS is_datetime
            FROM (SELECT {{c}} AS v FROM ({_DATED}) WHERE {{c}} IS NOT NULL)""",
    ),
)
def _(spark, sf):
    return types.datetime_probe(_dated(spark, sf))


@query(
    "column_types_late_text",
    """SELECT 'o_orderkey' AS "column", 'numeric' AS kind UNION ALL SELECT 'day_text', 'datetime'
       UNION ALL SELECT 'nearly', 'categorical' UNION ALL SELECT 'o_orderpriority', 'categorical'""",
)
def _(spark, sf):
    return types.column_types(_dated(spark, sf))


@query(
    "avg_text_length",
    each(_TEXTS, """SELECT '{c}' AS "column", round(avg(length({c})), 4) AS avg_length FROM documents"""),
)
def _(spark, sf):
    return types.avg_text_length(table(spark, sf, "documents")).withColumn("avg_length", F.round("avg_length", 4))


@query(
    "column_nunique",
    each(COLUMNS["lineitem"], """SELECT '{c}' AS "column", count(DISTINCT {c}) AS nunique FROM lineitem"""),
)
def _(spark, sf):
    return frequency.column_nunique(table(spark, sf, "lineitem"))


@query(
    "time_columns",
    """SELECT column_name AS "column" FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE'""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    names = types.time_columns(types.detect_column_types(df))
    return spark.createDataFrame([(n,) for n in names], "column string")


# --- profile -------------------------------------------------------------------------


def _table_sql(base: str, columns: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    k = len(columns)
    return f"""WITH base AS ({base}),
    a AS (SELECT count(*) AS n_rows, ({nulls})::BIGINT AS total_nulls FROM base),
    d AS (SELECT (coalesce(sum(c - 1), 0))::BIGINT AS duplicate_rows
          FROM (SELECT count(*) AS c FROM base GROUP BY ALL_COLUMNS)),
    p AS (SELECT n_rows, {k}::BIGINT AS n_cols, duplicate_rows, total_nulls, (n_rows * {k})::BIGINT AS total_values,
          {pct_sql("duplicate_rows", "n_rows")} AS duplicate_pct,
          {pct_sql("total_nulls", f"n_rows * {k}")} AS null_pct FROM a, d),
    q AS (SELECT *, round((100 - null_pct) * 0.6 + (100 - duplicate_pct) * 0.4, 1) AS quality_score FROM p)
    SELECT *, CASE WHEN quality_score >= 80 THEN 'Good' WHEN quality_score >= 60 THEN 'Fair' ELSE 'Poor' END
           AS quality_grade, quality_score >= 70 AS healthy FROM q""".replace("ALL_COLUMNS", ", ".join(columns))


_ORDERS_N_TABLE = _table_sql(ORDERS_N.sql, COLUMNS["orders"])
_ORDERS_D_TABLE = _table_sql(ORDERS_D.sql, ["o_orderstatus", "o_orderpriority", "y"])


@query("table_profile", _ORDERS_N_TABLE)
def _(spark, sf):
    return profile.table_profile(ORDERS_N.df(spark, sf))


@query("quality_score", f"SELECT null_pct, duplicate_pct, quality_score FROM ({_ORDERS_D_TABLE})")
def _(spark, sf):
    return profile.table_profile(ORDERS_D.df(spark, sf)).select("null_pct", "duplicate_pct", "quality_score")


@query("quality_grade", f"SELECT quality_score, quality_grade, healthy FROM ({_ORDERS_D_TABLE})")
def _(spark, sf):
    return profile.table_profile(ORDERS_D.df(spark, sf)).select("quality_score", "quality_grade", "healthy")


@query("duplicate_rows", f"SELECT duplicate_rows, duplicate_pct FROM ({_ORDERS_D_TABLE})")
def _(spark, sf):
    return profile.duplicate_rows(ORDERS_D.df(spark, sf))


@query("total_values", "SELECT count(*) * 11 AS total_values FROM lineitem")
def _(spark, sf):
    return profile.total_values(table(spark, sf, "lineitem"))


@query(
    "estimated_mb",
    "SELECT round(sum(16 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) / 1e6, 3) AS estimated_mb FROM documents",
)
def _(spark, sf):
    return profile.estimated_mb(table(spark, sf, "documents"))


_DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_NULLS_SQL = each(
    _DOCS_COLUMNS,
    f"""SELECT '{{c}}' AS "column", count(*) FILTER (WHERE {{c}} IS NULL) AS null_count,
        {pct_sql("count(*) FILTER (WHERE {c} IS NULL)", "count(*)")} AS null_pct FROM ({DOCS_L})""",
)


@query("null_counts", _NULLS_SQL)
def _(spark, sf):
    return profile.null_counts(docs_labels(spark, sf))


@query(
    "unique_counts",
    each(
        COLUMNS["orders"],
        f"""SELECT '{{c}}' AS "column", count(DISTINCT {{c}}) AS unique_count,
            {pct_sql("count(DISTINCT {c})", "count(*)")} AS unique_pct FROM ({ORDERS_N.sql})""",
    ),
)
def _(spark, sf):
    return frequency.unique_counts(ORDERS_N.df(spark, sf))


@query(
    "numeric_stats",
    each(
        NUMERIC["lineitem"],
        """SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max" FROM lineitem""",
    ),
)
def _(spark, sf):
    stats = profile.numeric_stats(table(spark, sf, "lineitem"))
    return stats.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "quantile_stats",
    each(
        NUMERIC["lineitem"],
        """SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
           round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
           round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM lineitem""",
    ),
)
def _(spark, sf):
    found = quantiles.quantile_stats(table(spark, sf, "lineitem"), NUMERIC["lineitem"])
    return found.select("column", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


_MANY = ["l_extendedprice", "l_quantity", "l_partkey"]


@query(
    "quantile_stats_refined",
    each(
        _MANY,
        """SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
           round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
           round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM lineitem""",
    ),
)
def _(spark, sf):
    """The same answers by brackets, as for tables of any size."""
    found = quantiles.quantile_stats(table(spark, sf, "lineitem"), _MANY, quantiles.Plan(builtin_cells=0))
    return found.select("column", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


@query(
    "quantile_stats_ranged",
    each(
        _MANY,
        """SELECT '{c}' AS "column", round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
           round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
           round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM lineitem""",
    ),
)
def _(spark, sf):
    """And with the values inside the brackets placed by range partitions."""
    plan = quantiles.Plan(builtin_cells=0, window_rows=0)
    found = quantiles.quantile_stats(table(spark, sf, "lineitem"), _MANY, plan)
    return found.select("column", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


_SHAPED = NUMERIC["lineitem"]


@query(
    "skewness",
    each(_SHAPED, """SELECT '{c}' AS "column", round(coalesce(skewness({c}), 0), 4) + 0.0 AS skewness FROM lineitem"""),
)
def _(spark, sf):
    return profile.skewness(table(spark, sf, "lineitem"))


@query(
    "kurtosis",
    each(_SHAPED, """SELECT '{c}' AS "column", round(coalesce(kurtosis({c}), 0), 4) + 0.0 AS kurtosis FROM lineitem"""),
)
def _(spark, sf):
    return profile.kurtosis(table(spark, sf, "lineitem"))


_FENCE_SQL = """(SELECT quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS lo,
    quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS hi FROM SOURCE)"""


def fence_sql(source: str) -> str:
    return _FENCE_SQL.replace("SOURCE", source)


@query(
    "iqr_fences",
    each(
        NUMERIC["events"],
        f"""SELECT '{{c}}' AS "column", round(lo, 6) AS iqr_lower, round(hi, 6) AS iqr_upper FROM {fence_sql("events")}""",
    ),
)
def _(spark, sf):
    return quantiles.iqr_fences(table(spark, sf, "events"), NUMERIC["events"])


@query(
    "outlier_counts",
    each(
        NUMERIC["events"],
        f"""SELECT '{{c}}' AS "column", count(*) FILTER (WHERE {{c}} < lo OR {{c}} > hi) AS outlier_count,
            {pct_sql("count(*) FILTER (WHERE {c} < lo OR {c} > hi)", "count(*)")} AS outlier_pct
            FROM events, {fence_sql("events")}""",
    ),
)
def _(spark, sf):
    return profile.outlier_counts(table(spark, sf, "events"), NUMERIC["events"])


def _tops_sql(source: str, k: int) -> str:
    return f"""SELECT '{{c}}' AS "column", {{c}} AS value, n AS count, "rank"::BIGINT AS "rank" FROM (
        SELECT {{c}}, n, row_number() OVER (ORDER BY n DESC, {{c}}) AS "rank" FROM (
            SELECT {{c}}, count(*) AS n FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}})) WHERE "rank" <= {k}"""


_CATS = ["p_name", "p_brand", "p_type"]


@query("top_values", each(_CATS, _tops_sql("part", 15)))
def _(spark, sf):
    top = frequency.top_values(table(spark, sf, "part"), _CATS, 15)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "top_value",
    "SELECT \"column\", value AS top_value, count AS top_freq, "
    + pct_sql("count", "(SELECT count(*) FROM orders)")
    + " AS top_freq_pct FROM ("
    + each(["o_orderstatus", "o_orderpriority"], _tops_sql(f"({ORDERS_N.sql})", 1))
    + ")",
)
def _(spark, sf):
    return frequency.top_value(ORDERS_N.df(spark, sf), ["o_orderstatus", "o_orderpriority"])


def profile_sql(base: str, columns: dict[str, str], digits: int = 4) -> str:
    """The column profile of ``base``: ``columns`` maps names to semantic kinds."""
    parts = []
    for c, kind in columns.items():
        common = f"""'{c}' AS "column", '{kind}' AS kind, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
            {pct_sql(f"count(*) FILTER (WHERE {c} IS NULL)", "count(*)")} AS null_pct,
            count(DISTINCT {c}) AS unique_count, {pct_sql(f"count(DISTINCT {c})", "count(*)")} AS unique_pct,
            count({c}) AS present"""
        if kind == "numeric":
            fence = fence_sql("base").replace("{c}", c)
            parts.append(f"""SELECT {common}, round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std,
                min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max",
                quantile_cont({c}::DOUBLE, 0.5) AS median,
                round(coalesce(skewness({c}), 0), 4) + 0.0 AS skewness,
                round(coalesce(kurtosis({c}), 0), 4) + 0.0 AS kurtosis,
                round(any_value(lo), {digits}) AS iqr_lower, round(any_value(hi), {digits}) AS iqr_upper,
                count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outlier_count,
                {pct_sql(f"count(*) FILTER (WHERE {c} < lo OR {c} > hi)", "count(*)")} AS outlier_pct,
                NULL::VARCHAR AS top_value, NULL::BIGINT AS top_freq FROM base, {fence}""")
        else:
            top = "NULL::VARCHAR AS top_value, NULL::BIGINT AS top_freq"
            if kind == "categorical":
                best = f"FROM base WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"
                top = f"(SELECT {c} {best}) AS top_value, (SELECT count(*) {best}) AS top_freq"
            nothing = ", ".join(
                f'NULL::DOUBLE AS "{k}"'
                for k in ("mean", "std", "min", "max", "median", "skewness", "kurtosis", "iqr_lower", "iqr_upper")
            )
            parts.append(
                f"SELECT {common}, {nothing}, NULL::BIGINT AS outlier_count, NULL::DOUBLE AS outlier_pct, {top} FROM base"
            )
    return f"WITH base AS ({base})\n" + "\nUNION ALL\n".join(parts)


PROFILE_FIELDS = [
    "column", "kind", "null_count", "null_pct", "unique_count", "unique_pct", "present", "mean", "std",
    "min", "max", "median", "skewness", "kurtosis", "iqr_lower", "iqr_upper", "outlier_count",
    "outlier_pct", "top_value", "top_freq",
]
ROUNDED = ("mean", "std", "iqr_lower", "iqr_upper")


def profile_frame(frame, digits: int = 4):
    return frame.select(PROFILE_FIELDS).withColumns({c: F.round(c, digits) for c in ROUNDED})


ORDERS_KINDS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical",
    "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "categorical",
}
_ORDERS_PROFILE = profile_sql(ORDERS_N.sql, ORDERS_KINDS)
_LINE_KINDS = {c: "numeric" for c in NUMERIC["lineitem"]} | {
    "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime"
}
_EVENT_KINDS = {
    "event_id": "numeric", "ts": "datetime", "user_id": "numeric", "event_type": "categorical",
    "value": "numeric", "props": "categorical",
}
EVENTS_PROFILE = profile_sql("SELECT * FROM events", _EVENT_KINDS)


@query("column_profile", _ORDERS_PROFILE)
def _(spark, sf):
    return profile_frame(profile.column_profile(ORDERS_N.df(spark, sf)))


@query("column_profile_lineitem", profile_sql("SELECT * FROM lineitem", _LINE_KINDS))
def _(spark, sf):
    return profile_frame(profile.column_profile(table(spark, sf, "lineitem")))


@query(
    "column_stats_table",
    f"""SELECT "column", kind, null_count, null_pct, unique_count, mean, std, "min", "max", skewness, kurtosis,
        outlier_count, top_value FROM ({EVENTS_PROFILE})""",
)
def _(spark, sf):
    shown = profile.column_stats_table(profile.profile(table(spark, sf, "events")))
    return shown.drop("dtype").withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "eda_stats",
    f"""SELECT "column", skewness, kurtosis, outlier_pct FROM ({EVENTS_PROFILE}) WHERE kind = 'numeric'""",
)
def _(spark, sf):
    return profile.eda_stats(profile.profile(table(spark, sf, "events")))


def _health_sql(profiled: str) -> str:
    return f"""SELECT "column", round(greatest(0.0, least(100.0, 100.0 - least(null_pct * 2, 50.0)
            - least(coalesce(outlier_pct, 0) * 1.5, 30.0)
            - CASE WHEN unique_pct < 0.5 AND unique_count < 2 THEN 20.0 ELSE 0.0 END)), 1) AS health_score,
        concat_ws('; ', CASE WHEN null_pct > 0 THEN printf('%.1f', null_pct) || '% missing' END,
            CASE WHEN outlier_pct > 0 THEN printf('%.1f', outlier_pct) || '% outliers' END,
            CASE WHEN unique_pct < 0.5 AND unique_count < 2 THEN 'near-constant' END) AS issues,
        null_pct, coalesce(outlier_pct, 0.0) AS outlier_pct FROM ({profiled})"""


def _joined_issues(health):
    return health.withColumn("issues", F.array_join("issues", "; "))


@query("column_health", _health_sql(EVENTS_PROFILE))
def _(spark, sf):
    p = profile.profile(table(spark, sf, "events"))
    return _joined_issues(profile.column_health(p))


@query(
    "columns_with_issues",
    f"""SELECT "column", kind, null_count, coalesce(outlier_count, 0) AS outlier_count FROM ({_ORDERS_PROFILE})
        WHERE null_count > 0 OR outlier_count > 0""",
)
def _(spark, sf):
    return profile.columns_with_issues(profile.profile(ORDERS_N.df(spark, sf)))


# --- quality rules -------------------------------------------------------------------

_LINE_X_COLUMNS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_gross", "l_const", "l_parttext", "l_returnflag"
]
_LINE_X_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_gross", "l_const"]


def _rule(kind, severity, action, value, body, column="'{c}'", column2="NULL::VARCHAR"):
    return f"""SELECT '{kind}' AS type, '{severity}' AS severity, {column} AS "column", {column2} AS column2,
        ({value})::DOUBLE AS value, '{action}' AS action {body}"""


def _ids_sql(columns, base):
    return each(
        columns,
        _rule("id_columns", "warning", "drop", "round(r, 4)",
              f"FROM (SELECT count(DISTINCT {{c}})::DOUBLE / greatest(count(*), 1) AS r FROM {base}) WHERE r >= 0.95"),
    )


def _constant_sql(columns, base):
    return each(
        columns,
        _rule("constant_columns", "error", "drop", "k",
              f"FROM (SELECT count(DISTINCT {{c}}) AS k FROM {base}) WHERE k <= 1"),
    )


def _pairs_sql(columns, base):
    return "\nUNION ALL\n".join(
        _rule("high_correlation", "info", "review", "round(abs(r), 3)",
              f"FROM (SELECT CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r FROM {base}) WHERE abs(r) >= 0.95",
              f"'{a}'", f"'{b}'")
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


def _skewed_sql(columns, base):
    return each(
        columns,
        _rule("skewed_columns", "info", "transform", "round(s, 2)",
              f"FROM (SELECT abs(coalesce(skewness({{c}}), 0)) AS s, count({{c}}) AS n FROM {base}) WHERE n > 10 AND s > 1.5"),
    )


def _missing_sql(columns, base):
    return each(
        columns,
        _rule("high_missing", "warning", "drop", "round(m * 100, 1)",
              f"FROM (SELECT (count(*) - count({{c}}))::DOUBLE / greatest(count(*), 1) AS m FROM {base}) WHERE m > 0.5"),
    )


def _text_numbers_sql(columns, base):
    return each(
        columns,
        _rule("numeric_strings", "warning", "convert", "round(m, 4)",
              f"FROM (SELECT count(TRY_CAST({{c}} AS DOUBLE))::DOUBLE / greatest(count(*), 1) AS m FROM {base}) WHERE m > 0.9"),
    )


@query("scan_id_columns", _ids_sql(COLUMNS["orders"], "orders"))
def _(spark, sf):
    return scan.scan_id_columns(profile.profile(table(spark, sf, "orders")))


@query("scan_constant", _constant_sql(_LINE_X_COLUMNS, f"({LINE_X.sql})"))
def _(spark, sf):
    return scan.scan_constant(profile.profile(LINE_X.df(spark, sf)))


@query("scan_high_corr", _pairs_sql(_LINE_X_NUMERIC, f"({LINE_X.sql})"))
def _(spark, sf):
    df = LINE_X.df(spark, sf)
    return scan.scan_high_corr(df, profile.profile(df))


@query("scan_skewed", _skewed_sql(NUMERIC["events"], "events"))
def _(spark, sf):
    return scan.scan_skewed(profile.profile(table(spark, sf, "events")))


@query("scan_high_missing", _missing_sql(_DOCS_COLUMNS, f"({DOCS_L})"))
def _(spark, sf):
    return scan.scan_high_missing(profile.profile(docs_labels(spark, sf)))


@query("scan_numeric_strings", _text_numbers_sql(["l_parttext", "l_returnflag"], f"({LINE_X.sql})"))
def _(spark, sf):
    df = LINE_X.df(spark, sf)
    return scan.scan_numeric_strings(df, profile.profile(df))


@query(
    "smart_scan",
    "\nUNION ALL\n".join(
        [
            _ids_sql(_LINE_X_COLUMNS, f"({LINE_X.sql})"),
            _constant_sql(_LINE_X_COLUMNS, f"({LINE_X.sql})"),
            _pairs_sql(_LINE_X_NUMERIC, f"({LINE_X.sql})"),
            _skewed_sql(_LINE_X_NUMERIC, f"({LINE_X.sql})"),
            _missing_sql(_LINE_X_COLUMNS, f"({LINE_X.sql})"),
            _text_numbers_sql(["l_parttext", "l_returnflag"], f"({LINE_X.sql})"),
        ]
    ),
)
def _(spark, sf):
    df = LINE_X.df(spark, sf)
    return scan.smart_scan(df, profile.profile(df))


# --- readiness -----------------------------------------------------------------------


def _ready_sql(base: str, columns: list[str], numeric: list[str], target: str) -> str:
    """All seven scores, unrounded, as one row."""
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)
    features = [c for c in columns if c != target]
    other = [c for c in features if c not in numeric]
    ranges = "\nUNION ALL\n".join(
        f"SELECT max({c})::DOUBLE - min({c})::DOUBLE AS r FROM base" for c in numeric if c != target
    )
    k, m = len(columns), len(features)
    return f"""WITH base AS ({base}),
    a AS (SELECT count(*) AS n, ({nulls})::DOUBLE AS nulls FROM base),
    d AS (SELECT coalesce(sum(c - 1), 0)::DOUBLE AS copies FROM (SELECT count(*) AS c FROM base GROUP BY {", ".join(columns)})),
    r AS (SELECT coalesce(least(min(r) / max(r) * 100, 100.0), 100.0) AS scale FROM ({ranges}) WHERE r > 0),
    b AS (SELECT CASE WHEN count(*) >= 2 THEN min(c)::DOUBLE / max(c) * 100 ELSE 50.0 END AS balance
          FROM (SELECT count(*) AS c FROM base WHERE {target} IS NOT NULL GROUP BY {target}))
    SELECT greatest(0.0, 100.0 - 5 * (nulls / greatest(n * {k}, 1) * 100)) AS completeness,
        greatest(0.0, (1 - {len(other)} / {len(features)}::DOUBLE) * 100) AS encoding,
        greatest(0.0, 100.0 - 10 * (copies / greatest(n, 1) * 100)) AS no_duplicates,
        scale AS scale_uniformity,
        (CASE WHEN n >= 100000 THEN 100.0 WHEN n >= 10000 THEN 90.0 WHEN n >= 1000 THEN 70.0 WHEN n >= 200 THEN 50.0
             ELSE greatest(5.0, n / 2.0) END)::DOUBLE AS sample_size,
        balance AS class_balance,
        (CASE WHEN {m} > 200 THEN greatest(20.0, 100 - ({m} - 200) * 0.3) WHEN {m} > 50 THEN greatest(60.0, 100 - ({m} - 50) * 0.8)
             WHEN {m} > 1 THEN 100.0 WHEN {m} = 1 THEN 30.0 ELSE 10.0 END)::DOUBLE AS feature_count, n AS n_rows, {k}::BIGINT AS n_cols
    FROM a, d, r, b"""


_READY = _ready_sql(ORDERS_N.sql, COLUMNS["orders"], NUMERIC["orders"], "o_orderstatus")
_READY_SCORE = f"""SELECT {", ".join(f"round({k}, 4) AS {k}" for k in readiness.WEIGHTS)}, n_rows, n_cols,
    round(raw, 1) AS score, CASE WHEN raw >= 88 THEN 'Excellent' WHEN raw >= 72 THEN 'Good' WHEN raw >= 55 THEN 'Fair'
    ELSE 'Needs Work' END AS grade
    FROM (SELECT *, {" + ".join(f"{k} * {w}" for k, w in readiness.WEIGHTS.items())} AS raw FROM ({_READY}))"""


@query("readiness_score", _READY_SCORE)
def _(spark, sf):
    return readiness.readiness_score(ORDERS_N.df(spark, sf), "o_orderstatus")


def _one_score(key: str, column: str):
    @query(key, f"SELECT round({column}, 4) AS {column} FROM ({_READY})")
    def _(spark, sf):
        return readiness.single_score(ORDERS_N.df(spark, sf), column, "o_orderstatus")


for _key, _column in (
    ("readiness_completeness", "completeness"),
    ("readiness_encoding", "encoding"),
    ("readiness_duplicates", "no_duplicates"),
    ("readiness_scale", "scale_uniformity"),
    ("readiness_size", "sample_size"),
    ("readiness_balance", "class_balance"),
    ("readiness_features", "feature_count"),
):
    _one_score(_key, _column)


ORDERS_C = View(
    "orders",
    ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "'c' || CAST(o_orderkey % 120 AS VARCHAR(10)) AS cat", "o_orderstatus"],
)


@query(
    "readiness_stages",
    f"""WITH k AS (SELECT count(DISTINCT cat) AS k FROM ({ORDERS_C.sql})),
    s AS (SELECT 'raw' AS stage, 5 AS m, 2 AS other UNION ALL SELECT 'dated', 6, 1 UNION ALL SELECT 'encoded', 5 + k, 0 FROM k)
    SELECT stage, round((1 - other / m::DOUBLE) * 100, 4) AS encoding, round((CASE WHEN m > 200 THEN greatest(20.0, 100 - (m - 200) * 0.3)
        WHEN m > 50 THEN greatest(60.0, 100 - (m - 50) * 0.8) ELSE 100.0 END)::DOUBLE, 4) AS feature_count, (m + 1)::BIGINT AS n_cols FROM s""",
)
def _(spark, sf):
    """The two scores of the schema before and after date parts and flags, whose number the data decides."""
    stages = {"raw": FeatureSpec(), "dated": FeatureSpec(datetime={"o_orderdate": ["year", "month"]})}
    stages["encoded"] = FeatureSpec(datetime={"o_orderdate": ["year", "month"]}, encoding={"cat": "onehot"})
    out = None
    for name, spec in stages.items():
        df = features.apply_features(ORDERS_C.df(spark, sf), spec)[0]
        found = readiness.scores(df, "o_orderstatus", ["encoding", "feature_count"]).select(
            F.lit(name).alias("stage"), F.round("encoding", 4).alias("encoding"), F.round("feature_count", 4).alias("feature_count"), "n_cols"
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "readiness_issues",
    f"""WITH s AS ({_READY})
    SELECT 'missing_data' AS issue, (CASE WHEN completeness = 0 THEN 'at least ' ELSE '' END)
        || printf('%.1f', (100 - completeness) / 5) || '% of cells missing: impute before training' AS detail FROM s WHERE completeness < 75
    UNION ALL SELECT 'encoding', '2 non-numeric columns still need encoding' FROM s WHERE encoding < 80
    UNION ALL SELECT 'duplicates', 'duplicate rows: remove them to avoid leakage' FROM s WHERE no_duplicates < 85
    UNION ALL SELECT 'scale', 'feature scales vary widely: normalise or standardise' FROM s WHERE scale_uniformity < 40
    UNION ALL SELECT 'class_balance', 'class imbalance: consider resampling or class weights' FROM s WHERE class_balance < 60
    UNION ALL SELECT 'sample_size', 'only ' || n_rows || ' rows: risk of overfitting' FROM s WHERE sample_size < 70
    UNION ALL SELECT 'feature_count', 'unsuitable number of features: consider reducing dimensions' FROM s WHERE feature_count < 60""",
)
def _(spark, sf):
    return readiness.readiness_issues(ORDERS_N.df(spark, sf), "o_orderstatus")
