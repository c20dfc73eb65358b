"""Exploratory chart data and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepflow.operators import correlation, eda, timeseries, types
from prepflow.queries.describe import fence_sql
from prepflow.queries.registry import (
    DOCS_L,
    EVENTS_N,
    LINE_X,
    NUMERIC,
    ORDERS_N,
    View,
    docs_labels,
    each,
    pct_sql,
    query,
    table,
)

# --- distributions -------------------------------------------------------------------

_BINS = """s AS (SELECT count({c}) AS n, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
        least(50, greatest(10, floor(sqrt(count({c})))))::BIGINT AS bins FROM {t})"""


def _bins(t: str, c: str) -> str:
    return _BINS.replace("{t}", t).replace("{c}", c)


@query(
    "histogram",
    f"""WITH {_bins("orders", "o_totalprice")},
    c AS (SELECT least(floor((o_totalprice - low) / ((high - low) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n
          FROM orders, s GROUP BY 1)
    SELECT b.bin, round(low + b.bin * ((high - low) / bins), 4) AS lo, round(low + (b.bin + 1) * ((high - low) / bins), 4) AS hi,
           coalesce(c.n, 0) AS count
    FROM s, (SELECT unnest(range(50)) AS bin) b LEFT JOIN c ON c.bin = b.bin WHERE b.bin < bins""",
)
def _(spark, sf):
    bins = eda.histogram(table(spark, sf, "orders"), "o_totalprice")
    return bins.withColumns({c: F.round(c, 4) for c in ("lo", "hi")})


def _kde_sql(t: str, c: str) -> str:
    return f"""WITH {_bins(t, c)},
    h AS (SELECT *, pow(n, -0.2) * (SELECT stddev_samp({c}) FROM {t}) AS h FROM s),
    g AS (SELECT unnest(range(300)) AS point),
    v AS (SELECT {c}::DOUBLE AS v, count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)
    SELECT point::BIGINT AS point, low + point * ((high - low) / 299) AS x,
        sum(k * exp(-0.5 * pow((low + point * ((high - low) / 299) - v) / h, 2)))
            * (any_value(high) - any_value(low)) / any_value(bins) / (any_value(h) * sqrt(2 * pi())) AS y
    FROM g, h, v GROUP BY point, low, high"""


@query("kde", f"SELECT point, round(x, 6) AS x, round(y, 4) AS y FROM ({_kde_sql('events', 'value')})")
def _(spark, sf):
    return eda.kde(table(spark, sf, "events"), "value").withColumns({"x": F.round("x", 6), "y": F.round("y", 4)})


def _box_sql(t: str, c: str) -> str:
    return f"""SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3,
        min({c}) FILTER (WHERE {c} BETWEEN lo AND hi) AS whisker_low, max({c}) FILTER (WHERE {c} BETWEEN lo AND hi) AS whisker_high,
        count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers, avg({c}) AS mean, any_value(lo) AS lower, any_value(hi) AS upper
        FROM {t}, {fence_sql(t).replace("{c}", c)}"""


@query(
    "box_stats",
    f"""SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, whisker_low, whisker_high, outliers
        FROM ({_box_sql("events", "value")})""",
)
def _(spark, sf):
    box = eda.box_stats(table(spark, sf, "events"), "value")
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "box_outliers",
    f"""SELECT value, count(*) AS count FROM events, {fence_sql("events").replace("{c}", "value")}
        WHERE value < lo OR value > hi GROUP BY value""",
)
def _(spark, sf):
    return eda.box_outliers(table(spark, sf, "events"), "value")


@query(
    "violin_stats",
    f"""WITH b AS ({_box_sql("events", "value")})
    SELECT 'density' AS part, point::VARCHAR AS label, round(x, 6) AS x, round(y, 4) AS y FROM ({_kde_sql("events", "value")})
    UNION ALL """
    + each(
        ["q1", "median", "q3", "mean", "lower", "upper", "whisker_low", "whisker_high"],
        "SELECT 'summary', '{c}', round({c}, 6), NULL::DOUBLE FROM b",
    ),
)
def _(spark, sf):
    return eda.violin_stats(table(spark, sf, "events"), "value").withColumns(
        {"x": F.round("x", 6), "y": F.round("y", 4)}
    )


@query(
    "grouped_violin",
    """WITH s AS (SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean,
            pow(count(value), -0.2) * stddev_samp(value) AS h,
            least(50, greatest(10, floor(sqrt(count(value))))) AS bins,
            quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
            FROM events GROUP BY event_type),
    v AS (SELECT event_type, value AS v, count(*) AS k FROM events GROUP BY ALL),
    d AS (SELECT event_type, point, low + point * ((high - low) / 299) AS x,
            sum(k * exp(-0.5 * pow((low + point * ((high - low) / 299) - v) / h, 2)))
            * (any_value(high) - any_value(low)) / any_value(bins) / (any_value(h) * sqrt(2 * pi())) AS y
            FROM (SELECT unnest(range(300)) AS point), s JOIN v USING (event_type) GROUP BY event_type, point, low, high)
    SELECT event_type AS "group", 'density' AS part, point::VARCHAR AS label, round(x, 6) AS x, round(y, 4) AS y FROM d
    UNION ALL """
    + each(
        ["q1", "median", "q3", "mean"],
        "SELECT event_type, 'summary', '{c}', round({c}, 6), NULL::DOUBLE FROM s",
    ),
)
def _(spark, sf):
    return eda.grouped_violin(table(spark, sf, "events"), "value", "event_type").withColumns(
        {"x": F.round("x", 6), "y": F.round("y", 4)}
    )


@query(
    "category_bars",
    """SELECT p_type AS value, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM part) * 100, 1) AS pct
       FROM part WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count DESC, p_type LIMIT 15""",
)
def _(spark, sf):
    return eda.category_bars(table(spark, sf, "part"), "p_type", 15)


_DOCS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query(
    "missing_bars",
    """SELECT "column", null_pct, CASE WHEN null_pct < 5 THEN 'low' WHEN null_pct < 20 THEN 'medium' ELSE 'high' END AS band FROM ("""
    + each(
        _DOCS,
        f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS k,
            {pct_sql("count(*) - count({c})", "count(*)")} AS null_pct FROM ({DOCS_L})""",
    )
    + ") WHERE k > 0",
)
def _(spark, sf):
    return eda.missing_bars(docs_labels(spark, sf))


# --- correlation ---------------------------------------------------------------------

_LX = ["l_quantity", "l_extendedprice", "l_discount", "l_gross", "l_const"]


def _r(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _matrix_sql(columns, base, digits=2, lower=False) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {i}::BIGINT AS i, {j}::BIGINT AS j, round({_r(a, b)}, {digits}) + 0.0 AS r FROM base"""
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if not lower or i >= j
    ).join([f"WITH base AS ({base})\n", ""])


def _long_ids(matrix):
    return matrix.withColumns({"i": F.col("i").cast("bigint"), "j": F.col("j").cast("bigint"), "r": F.col("r") + 0.0})


@query("corr_pearson", _matrix_sql(_LX, LINE_X.sql))
def _(spark, sf):
    return _long_ids(correlation.corr_pearson(LINE_X.df(spark, sf)))


@query("corr_lower_triangle", _matrix_sql(NUMERIC["lineitem"], "SELECT * FROM lineitem", lower=True))
def _(spark, sf):
    matrix = correlation.corr_pearson(table(spark, sf, "lineitem"))
    return _long_ids(correlation.corr_lower_triangle(matrix))


@query(
    "corr_spearman",
    "WITH t AS ("
    + ORDERS_N.sql
    + """), full_pair AS (SELECT rank() OVER (ORDER BY o_orderkey) + (count(*) OVER (PARTITION BY o_orderkey) - 1) / 2.0 AS a,
            rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b FROM t),
    gap AS (SELECT rank() OVER (ORDER BY o_orderkey) + (count(*) OVER (PARTITION BY o_orderkey) - 1) / 2.0 AS a,
            rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS b,
            rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS c
            FROM t WHERE o_totalprice IS NOT NULL),
    m AS (SELECT 0 AS i, 0 AS j, 1.0::DOUBLE AS r UNION ALL SELECT 1, 1, 1.0 UNION ALL SELECT 2, 2, 1.0
          UNION ALL SELECT 0, 1, corr(a, b) FROM full_pair UNION ALL SELECT 0, 2, corr(a, c) FROM gap
          UNION ALL SELECT 1, 2, corr(b, c) FROM gap),
    names AS (SELECT * FROM (VALUES (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_totalprice')) v(k, name))
    SELECT x.name AS col_a, y.name AS col_b, x.k::BIGINT AS i, y.k::BIGINT AS j, round(r, 4) + 0.0 AS r
    FROM m, names x, names y WHERE least(x.k, y.k) = m.i AND greatest(x.k, y.k) = m.j""",
)
def _(spark, sf):
    df = ORDERS_N.df(spark, sf)
    return _long_ids(correlation.corr_spearman(df, ["o_orderkey", "o_custkey", "o_totalprice"], digits=4))


def _gap(i: int, c: str) -> str:
    """A column with gaps of its own."""
    return f"CASE WHEN (l_orderkey * {i + 3} + l_linenumber * {2 * i + 1}) % {i + 5} <> 0 THEN {c} END AS x{i}"


_GAPPED = View("lineitem", [_gap(i, c) for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"])])


def _spearman_pair(i: int, j: int) -> str:
    rank = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    a, b = (rank.format(x=f"x{k}") for k in (i, j))
    return f"SELECT {i} AS i, {j} AS j, corr(a, b) AS r FROM (SELECT {a} AS a, {b} AS b FROM t WHERE x{i} IS NOT NULL AND x{j} IS NOT NULL)"


@query(
    "corr_spearman_gaps",
    f"WITH t AS ({_GAPPED.sql}), m AS ("
    + " UNION ALL ".join(_spearman_pair(i, j) for i in range(6) for j in range(i + 1, 6))
    + " UNION ALL SELECT k, k, 1.0 FROM range(6) q(k)), n AS (SELECT k FROM range(6) q(k))"
    + """ SELECT 'x' || x.k::VARCHAR AS col_a, 'x' || y.k::VARCHAR AS col_b, x.k::BIGINT AS i, y.k::BIGINT AS j, round(r, 4) + 0.0 AS r
    FROM m, n x, n y WHERE least(x.k, y.k) = m.i AND greatest(x.k, y.k) = m.j""",
)
def _(spark, sf):
    """Six columns, each with its own gaps: every pair is ranked on its own rows."""
    return _long_ids(correlation.corr_spearman(_GAPPED.df(spark, sf), digits=4))


@query(
    "corr_pearson_wide",
    "WITH p AS ("
    + "\nUNION ALL\n".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {i}::BIGINT AS i, {j}::BIGINT AS j, corr({a}, {b}) AS r FROM lineitem"""
        for i, a in enumerate(NUMERIC["lineitem"])
        for j, b in enumerate(NUMERIC["lineitem"])
    )
    + ") SELECT col_a, col_b, i, j, round(r, 6) + 0.0 AS r FROM p",
)
def _(spark, sf):
    """Cross products summed in blocks, as for tables with many columns."""
    found = correlation.corr_pearson(table(spark, sf, "lineitem"), NUMERIC["lineitem"], 6, summed_columns=0)
    return _long_ids(found)


@query(
    "target_corr",
    "SELECT \"column\", round(r, 4) AS abs_r, CASE WHEN r >= 0.5 THEN 'strong' WHEN r >= 0.2 THEN 'moderate' ELSE 'weak' END AS band FROM ("
    + each(
        [c for c in _LX if c != "l_gross"],
        f"""SELECT '{{c}}' AS "column", abs(CASE WHEN isnan(corr({{c}}, l_gross)) THEN NULL ELSE corr({{c}}, l_gross) END) AS r FROM ({LINE_X.sql})""",
    )
    + ") WHERE r IS NOT NULL",
)
def _(spark, sf):
    return correlation.target_corr(LINE_X.df(spark, sf), "l_gross")


@query(
    "corr_pair",
    f"""SELECT 'l_extendedprice' AS col_a, 'l_gross' AS col_b, round(corr(l_extendedprice, l_gross), 4) AS r FROM ({LINE_X.sql})""",
)
def _(spark, sf):
    return correlation.corr_pair(LINE_X.df(spark, sf), "l_extendedprice", "l_gross")


# --- points --------------------------------------------------------------------------


@query(
    "scatter_points",
    f"""SELECT o_custkey, o_totalprice, o_orderpriority FROM ({ORDERS_N.sql})
        WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL""",
)
def _(spark, sf):
    return eda.scatter_points(ORDERS_N.df(spark, sf), "o_custkey", "o_totalprice", "o_orderpriority")


@query(
    "scatter_matrix",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM ({ORDERS_N.sql})
        WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""",
)
def _(spark, sf):
    return eda.scatter_matrix(
        ORDERS_N.df(spark, sf), ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderpriority"
    )


@query(
    "pair_points",
    f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM ({ORDERS_N.sql}) WHERE o_totalprice IS NOT NULL",
)
def _(spark, sf):
    df = ORDERS_N.df(spark, sf)
    return eda.pair_points(df, types.detect_column_types(df), "o_orderpriority")


@query(
    "scatter_3d",
    f"""SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM ({ORDERS_N.sql}) WHERE o_totalprice IS NOT NULL""",
)
def _(spark, sf):
    return eda.scatter_3d(ORDERS_N.df(spark, sf), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(
    "hierarchy_rollup",
    f"""SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total,
            (2 - bit_count(GROUPING(o_orderstatus, o_orderpriority)))::BIGINT AS level
        FROM ({ORDERS_N.sql}) WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL
        GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING GROUPING(o_orderstatus) = 0""",
)
def _(spark, sf):
    rolled = eda.hierarchy_rollup(ORDERS_N.df(spark, sf), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return rolled.withColumn("total", F.round("total", 2))


_PCA = View("lineitem", ["l_quantity", "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice"])
_PCA_FILLED = f"""SELECT l_quantity AS a, coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM ({_PCA.sql}))) AS b FROM ({_PCA.sql})"""


@query(
    "pca",
    f"""WITH r AS (SELECT abs(corr(a, b)) AS r FROM ({_PCA_FILLED}))
    SELECT 'PC1' AS component, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM r
    UNION ALL SELECT 'PC2', round((1 - r) / 2, 6), 1.0 FROM r""",
)
def _(spark, sf):
    df = _PCA.df(spark, sf)
    return eda.pca(df).variance(df).withColumns({c: F.round(c, 6) for c in ("explained", "cumulative")})


@query(
    "pca_scores",
    f"""WITH f AS ({_PCA_FILLED}), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, sign(corr(a, b)) AS g FROM f)
    SELECT round(((a - ma) / sa + g * (b - mb) / sb) / sqrt(2), 4) + 0.0 AS "PC1",
           round(((a - ma) / sa - g * (b - mb) / sb) / sqrt(2), 4) + 0.0 AS "PC2" FROM f, s""",
)
def _(spark, sf):
    df = _PCA.df(spark, sf)
    return eda.pca(df).scores(df).select(*[(F.round(c, 4) + 0.0).alias(c) for c in ("PC1", "PC2")])


# --- time series ---------------------------------------------------------------------


def _events(spark, sf):
    return timeseries.prepare(table(spark, sf, "events"), "ts", "value", ["event_id"])


def _gappy(spark, sf):
    return timeseries.prepare(EVENTS_N.df(spark, sf), "ts", "value", ["event_id"])


_E = """e AS (SELECT event_id, event_type, ts, value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx,
        count(*) OVER () AS n FROM {src} WHERE ts IS NOT NULL AND value IS NOT NULL)"""
_SERIES = "WITH " + _E.replace("{src}", "events")
_SERIES_N = "WITH " + _E.replace("{src}", f"({EVENTS_N.sql})")
_KEYED = """WITH e AS (SELECT event_id, event_type, ts, value AS v,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""


@query("ts_prepare", f"{_SERIES_N} SELECT event_id, v, idx::BIGINT AS idx, n FROM e")
def _(spark, sf):
    return _gappy(spark, sf).frame.select("event_id", "v", "idx", "n")


@query("ts_prepare_keyed", f"{_KEYED} SELECT event_type, event_id, v, idx::BIGINT AS idx, n FROM e")
def _(spark, sf):
    series = timeseries.prepare(table(spark, sf, "events"), "ts", "value", ["event_id"], ["event_type"])
    return series.frame.select("event_type", "event_id", "v", "idx", "n")


_FREQ = """SELECT {k} n_dates, CASE WHEN n_dates >= 3 THEN days END AS median_days,
    CASE WHEN n_dates < 3 OR days IS NULL THEN 'Unknown' WHEN days <= 1 THEN 'Hourly / Daily' WHEN days <= 7 THEN 'Daily'
         WHEN days <= 14 THEN 'Weekly' WHEN days <= 35 THEN 'Monthly' WHEN days <= 100 THEN 'Quarterly' ELSE 'Yearly' END AS frequency
    FROM (SELECT {k} count(*) AS n_dates, floor(quantile_cont(gap, 0.5) / 86400000000)::BIGINT AS days FROM (
        SELECT {k} (epoch_us(d) - lag(epoch_us(d)) OVER ({p} ORDER BY d))::DOUBLE AS gap FROM {src}) {g})"""


@query(
    "infer_frequency",
    _FREQ.replace("{k}", "").replace("{p}", "").replace("{g}", "").replace(
        "{src}", "(SELECT o_orderdate AS d FROM orders WHERE o_orderdate IS NOT NULL)"
    ),
)
def _(spark, sf):
    return timeseries.infer_frequency(table(spark, sf, "orders"), "o_orderdate")


@query(
    "infer_frequency_keyed",
    _FREQ.replace("{k}", "o_custkey,").replace("{p}", "PARTITION BY o_custkey").replace("{g}", "GROUP BY o_custkey").replace(
        "{src}", "(SELECT o_custkey, o_orderdate AS d FROM orders WHERE o_orderdate IS NOT NULL)"
    ),
)
def _(spark, sf):
    return timeseries.infer_frequency(table(spark, sf, "orders"), "o_orderdate", ["o_custkey"])


def _roll_sql(stat: str, w: int, part: str = "") -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    before, after = (w // 2, (w - 1) // 2) if stat in ("mean", "std") else (w - 1, 0)
    frame = f"OVER ({part} ORDER BY ts, event_id ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN n > {w} AND count(v) {frame} = {w} THEN round({fn}(v) {frame}, 6) END AS {stat}_{w}"


def _rounded(df, prefix=("mean", "std", "min", "max")):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.split("_")[0] in prefix})


def _rolling_query(key: str, stat: str, w: int):
    @query(key, f"{_SERIES} SELECT event_id, v, idx::BIGINT AS idx, {_roll_sql(stat, w)} FROM e")
    def _(spark, sf):
        out = timeseries.rolling(_events(spark, sf), [w], [stat])
        return _rounded(out.select("event_id", "v", "idx", f"{stat}_{w}"))


for _key, _stat, _w in (
    ("rolling_mean", "mean", 7),
    ("rolling_std", "std", 14),
    ("rolling_min", "min", 7),
    ("rolling_max", "max", 30),
):
    _rolling_query(_key, _stat, _w)


@query(
    "rolling_multi",
    f"""{_SERIES_N} SELECT event_id, v, idx::BIGINT AS idx,
        {", ".join(_roll_sql(s, w) for w in (7, 14, 30) for s in ("mean", "std", "min", "max"))} FROM e""",
)
def _(spark, sf):
    return _rounded(timeseries.rolling(_gappy(spark, sf)).drop("t", "n"))


@query(
    "rolling_multi_chunks",
    f"""{_SERIES_N} SELECT event_id, v, idx::BIGINT AS idx,
        {", ".join(_roll_sql(s, w) for w in (7, 30) for s in ("mean", "std", "min", "max"))} FROM e""",
)
def _(spark, sf):
    """The same frames over many chunks, as for long series."""
    return _rounded(timeseries.rolling(_gappy(spark, sf), (7, 30), chunk=256).drop("t", "n"))


@query(
    "rolling_keyed",
    f"""{_KEYED} SELECT event_type, event_id, {_roll_sql("mean", 7, "PARTITION BY event_type")},
        {_roll_sql("max", 7, "PARTITION BY event_type")} FROM e""",
)
def _(spark, sf):
    series = timeseries.prepare(table(spark, sf, "events"), "ts", "value", ["event_id"], ["event_type"])
    out = timeseries.rolling(series, [7], ["mean", "max"])
    return _rounded(out.select("event_type", "event_id", "mean_7", "max_7"))


@query("ts_line", f"{_SERIES_N} SELECT event_id, idx::BIGINT AS idx, v, {_roll_sql('mean', 7)} FROM e")
def _(spark, sf):
    return _rounded(timeseries.ts_line(_gappy(spark, sf), 7).select("event_id", "idx", "v", "mean_7"))


@query(
    "ts_rolling_panel",
    f"{_SERIES} SELECT event_id, idx::BIGINT AS idx, v, {_roll_sql('mean', 8)}, {_roll_sql('std', 8)} FROM e",
)
def _(spark, sf):
    panel = timeseries.ts_rolling_panel(_events(spark, sf), 8)
    return _rounded(panel.select("event_id", "idx", "v", "mean_8", "std_8"))


_DIRECTION = "CASE WHEN s > 0.001 THEN 'Upward' WHEN s < -0.001 THEN 'Downward' ELSE 'Flat' END AS direction"


@query(
    "trend_slope",
    f"{_KEYED} SELECT event_type, round(s, 6) + 0.0 AS slope, {_DIRECTION} FROM (SELECT event_type, regr_slope(v, idx) AS s FROM e GROUP BY event_type)",
)
def _(spark, sf):
    series = timeseries.prepare(table(spark, sf, "events"), "ts", "value", ["event_id"], ["event_type"])
    return timeseries.trend_slope(series).withColumn("slope", F.col("slope") + 0.0)


def _adf_terms(by: str, base: str) -> str:
    """The test with no or one lagged change, whichever has the smaller AIC, from centred sums.

    With y the change, x the level before it and z the change before that, the regressions on x
    alone and on x and z have closed forms.
    """
    return f"""{base}, l AS (SELECT {by} AS k, idx, n, v, lag(v) OVER w AS x, lag(v, 2) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY {by} ORDER BY idx)),
    d AS (SELECT k, idx, v - x AS y, x, x - x2 AS z FROM l WHERE idx >= 1),
    s AS (SELECT k, f, count(*)::DOUBLE AS n, var_pop(y) * count(*) AS syy, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy,
            var_pop(z) * count(*) AS szz, covar_pop(x, z) * count(*) AS sxz, covar_pop(z, y) * count(*) AS szy
          FROM d, (VALUES (1), (2)) r(f) WHERE idx >= f GROUP BY k, f),
    m AS (SELECT *, syy - sxy * sxy / sxx AS ssr0, sxx * szz - sxz * sxz AS det, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx,
            (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz FROM s),
    a AS (SELECT *, syy - bx * sxy - bz * szy AS ssr1 FROM m),
    pick AS (SELECT k, CASE WHEN n * ln(ssr1 / n) + 6 < n * ln(ssr0 / n) + 4 THEN 1 ELSE 0 END AS lags FROM a WHERE f = 2),
    t AS (SELECT a.k, lags, n, CASE WHEN lags = 0 THEN sxy / sxx / sqrt(ssr0 / (n - 2) / sxx) ELSE bx / sqrt(ssr1 / (n - 3) * szz / det) END AS stat
          FROM a JOIN pick ON a.k = pick.k AND a.f = pick.lags + 1)"""


def _adf_sql(by: str, base: str) -> str:
    return f"""{_adf_terms(by, base)}
    SELECT k AS series, round(stat, 6) AS statistic, lags::BIGINT AS lags_used, n::BIGINT AS n_obs,
        round(-3.43035 - 6.5393 / n - 16.786 / n ** 2 - 79.433 / n ** 3, 6) AS critical_1,
        round(-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3, 6) AS critical_5,
        round(-2.56677 - 1.5384 / n - 2.809 / n ** 2, 6) AS critical_10,
        stat < -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.040 / n ** 3 AS is_stationary FROM t"""


@query(
    "ts_summary",
    f"""{_adf_terms("'all'", _SERIES_N)} SELECT n_points, start, "end", round(m, 4) AS mean, round(s, 4) AS std, lo AS "min", hi AS "max",
        round(s / (m + 1e-9) * 100, 2) AS cv_pct, round(sl, 6) + 0.0 AS slope, {_DIRECTION.replace("s >", "sl >").replace("s <", "sl <")},
        round(stat, 6) AS adf_statistic, CASE WHEN stat < -18.83 THEN 0.0::DOUBLE END AS adf_p_value, stat < -18.83 AS stationary,
        dropped AS dropped_points
        FROM t, (SELECT count(*) AS n_points, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end",
              avg(v) AS m, stddev_samp(v) AS s, min(v) AS lo, max(v) AS hi, regr_slope(v, idx) AS sl,
              (SELECT count(*) FROM events) - count(*) AS dropped FROM e)""",
)
def _(spark, sf):
    """Every column; the test tries lag orders up to 1, which SQL can say. Below -18.83 its p-value is 0."""
    summary = timeseries.ts_summary(EVENTS_N.df(spark, sf), "ts", "value", ["event_id"], max_lags=1)
    return summary.withColumn("slope", F.col("slope") + 0.0)


@query("ts_summary_all_lags")
def _(spark, sf):
    """With every lag order, as by default: the same figures but for those of the test."""
    return timeseries.ts_summary(EVENTS_N.df(spark, sf), "ts", "value", ["event_id"])


def _adf_rows(series, name):
    found = timeseries.adf_frame(series, max_lags=1)
    figures = ("statistic", "critical_1", "critical_5", "critical_10")
    return found.select(
        name.alias("series"), "lags_used", "n_obs", "is_stationary", *[F.round(c, 6).alias(c) for c in figures]
    )


@query("adf_test", _adf_sql("'all'", _SERIES))
def _(spark, sf):
    return _adf_rows(_events(spark, sf), F.lit("all"))


@query("adf_test_keyed", _adf_sql("event_type", _KEYED))
def _(spark, sf):
    return _adf_rows(_events_by_type(spark, sf), F.col("event_type"))


@query("adf_test_all_lags")
def _(spark, sf):
    return timeseries.adf_frame(_events(spark, sf))


@query(
    "variance_ratio",
    f"""{_SERIES}, r AS (SELECT count(*) AS n_points, var_samp(v) FILTER (WHERE idx >= n // 2)
        / (var_samp(v) FILTER (WHERE idx < n // 2) + 1e-9) AS ratio FROM e)
        SELECT n_points, round(ratio, 6) AS ratio, ratio > 0.5 AND ratio < 2 AS stationary FROM r""",
)
def _(spark, sf):
    return timeseries.variance_ratio(_events(spark, sf)).withColumn("ratio", F.round("ratio", 6))


def _decompose_sql(m: int, keyed: bool = False) -> str:
    """By series of an event type, or of the one series that all events are."""
    h = m // 2
    key, base = ("event_type", _KEYED) if keyed else ("1", _SERIES)
    frame = f"OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    total = f"sum(v) {frame}"
    if m % 2 == 0:
        total = f"({total} - (first(v) {frame} + last(v) {frame}) / 2)"
    return f"""{base}, x AS (SELECT *, {key} AS k FROM e),
    t AS (SELECT k, event_id, idx, n, v, CASE WHEN count(*) {frame} = {2 * h + 1} THEN {total} / {m} END AS tr FROM x),
    ends AS (SELECT k, regr_slope(tr, idx) FILTER (WHERE idx >= {h} AND idx < {h + m}) AS s0,
            regr_intercept(tr, idx) FILTER (WHERE idx >= {h} AND idx < {h + m}) AS i0,
            regr_slope(tr, idx) FILTER (WHERE idx >= n - 1 - {h} - {m} AND idx < n - 1 - {h}) AS s1,
            regr_intercept(tr, idx) FILTER (WHERE idx >= n - 1 - {h} - {m} AND idx < n - 1 - {h}) AS i1 FROM t GROUP BY k),
    f AS (SELECT t.k, event_id, idx, v, CASE WHEN idx < {h} THEN s0 * idx + i0 WHEN idx > n - 1 - {h} THEN s1 * idx + i1 ELSE tr END AS trend
          FROM t JOIN ends ON t.k = ends.k),
    p AS (SELECT k, idx % {m} AS ph, avg(v - trend) AS pm FROM f GROUP BY 1, 2),
    q AS (SELECT k, ph, pm - avg(pm) OVER (PARTITION BY k) AS seasonal FROM p)
    SELECT event_id, v, round(trend, 6) + 0.0 AS trend, round(seasonal, 6) + 0.0 AS seasonal, round(v - trend - seasonal, 6) + 0.0 AS resid
    FROM f JOIN q ON f.k = q.k AND f.idx % {m} = q.ph"""


def _parts(df):
    return df.select(
        "event_id", "v", *[(F.round(c, 6) + 0.0).alias(c) for c in ("trend", "seasonal", "resid")]
    )


@query("decompose", _decompose_sql(12))
def _(spark, sf):
    return _parts(timeseries.decompose(_events(spark, sf)))


def _events_by_type(spark, sf):
    return timeseries.prepare(table(spark, sf, "events"), "ts", "value", ["event_id"], ["event_type"])


@query("decompose_keyed", _decompose_sql(7, keyed=True))
def _(spark, sf):
    return _parts(timeseries.decompose(_events_by_type(spark, sf), 7))


@query("decompose_odd_period", _decompose_sql(7))
def _(spark, sf):
    return _parts(timeseries.decompose(_events(spark, sf), 7))


@query(
    "decompose_ma",
    f"""{_SERIES}, t AS (SELECT *, avg(v) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS trend FROM e),
    s AS (SELECT *, avg(v - trend) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS seasonal FROM t)
    SELECT event_id, v, round(trend, 6) + 0.0 AS trend, round(seasonal, 6) + 0.0 AS seasonal,
        round(v - trend - seasonal, 6) + 0.0 AS resid FROM s""",
)
def _(spark, sf):
    return _parts(timeseries.decompose_ma(_events(spark, sf)))


def _lags_keyed_sql(max_lag: int) -> str:
    lagged = ", ".join(f"lag(v, {k}) OVER (PARTITION BY event_type ORDER BY idx) AS l{k}" for k in range(1, max_lag + 1))
    rows = "\nUNION ALL\n".join(
        f"SELECT event_type, {k}::BIGINT AS lag, round(corr(v, l{k}), 4) + 0.0 AS autocorr FROM m GROUP BY event_type HAVING {k} < count(*) // 2 AND NOT isnan(corr(v, l{k}))"
        for k in range(1, max_lag + 1)
    )
    return f"{_KEYED}, m AS (SELECT event_type, v, {lagged} FROM e) {rows}"


@query(
    "lag_strength_keyed",
    f"""SELECT event_type, lag, autocorr, CASE WHEN abs(autocorr) > 0.5 THEN 'Strong' WHEN abs(autocorr) > 0.2 THEN 'Moderate' ELSE 'Weak' END AS strength
        FROM ({_lags_keyed_sql(7)}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY abs(autocorr) DESC, lag) <= 3""",
)
def _(spark, sf):
    lags = timeseries.autocorr_lags(_events_by_type(spark, sf), 7).withColumn("autocorr", F.col("autocorr") + 0.0)
    return timeseries.lag_strength(lags, keys=["event_type"])


def _lags_sql(max_lag: int) -> str:
    lagged = ", ".join(f"lag(v, {k}) OVER (ORDER BY idx) AS l{k}" for k in range(1, max_lag + 1))
    rows = "\nUNION ALL\n".join(
        f"SELECT {k}::BIGINT AS lag, round(corr(v, l{k}), 4) + 0.0 AS autocorr FROM m WHERE {k} < (SELECT count(*) // 2 FROM m) HAVING NOT isnan(corr(v, l{k}))"
        for k in range(1, max_lag + 1)
    )
    return f"{_SERIES}, m AS (SELECT v, {lagged} FROM e) {rows}"


@query("autocorr_lags", _lags_sql(14))
def _(spark, sf):
    return timeseries.autocorr_lags(_events(spark, sf), 14).withColumn("autocorr", F.col("autocorr") + 0.0)


@query(
    "lag_strength",
    f"""SELECT lag, autocorr, CASE WHEN abs(autocorr) > 0.5 THEN 'Strong' WHEN abs(autocorr) > 0.2 THEN 'Moderate' ELSE 'Weak' END AS strength
        FROM ({_lags_sql(14)}) ORDER BY abs(autocorr) DESC, lag LIMIT 3""",
)
def _(spark, sf):
    lags = timeseries.autocorr_lags(_events(spark, sf), 14).withColumn("autocorr", F.col("autocorr") + 0.0)
    return timeseries.lag_strength(lags)
