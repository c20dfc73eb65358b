"""Stored plans replay, reports write, and row-level plans keep their shape."""

import pytest
from pyspark.sql import functions as F

from prepflow import session
from prepflow.operators import cleaning, eda, features, ordering, profile, timeseries
from prepflow.operators import features as fe
from prepflow.operators.cleaning import CleanSpec, ColumnRule
from prepflow.operators.features import FeatureSpec
from prepflow.plans.report import report_tables, write_report
from prepflow.plans.spec import FittedPrep, PrepSpec

SPEC = PrepSpec(
    CleanSpec(True, {"v": ColumnRule("median", "cap"), "s": ColumnRule("mode"), "w": ColumnRule("ffill")}, ("k",)),
    FeatureSpec(
        datetime={"d": ["year", "dayofweek"]},
        encoding={"s": "label"},
        scaling={"v": "standard"},
        custom_formulas=[{"name": "twice", "formula": "v * 2"}],
        binning=[{"col": "v", "bins": 3}],
    ),
)


def _frame(spark, n=60, offset=0):
    rows = [
        (i, None if i % 7 == 0 else float(i % 13) + offset, None if i % 5 == 0 else f"s{i % 4}", None if i % 2 else i, "2024-03-%02d" % (i % 28 + 1))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "k int, v double, s string, w int, d string").selectExpr("k", "v", "s", "w", "cast(d as date) d")


@pytest.mark.parametrize("local", [10_000, 0])
def test_save_load_replay(spark, tmp_path, monkeypatch, local):
    monkeypatch.setattr(fe, "LOCAL_CLASSES", local)
    monkeypatch.setattr(fe, "MAP_CLASSES", min(local, 200))
    df = _frame(spark)
    fitted = SPEC.fit(df)
    path = str(tmp_path / "plan")
    fitted.save(spark, path)
    loaded = FittedPrep.load(spark, path)
    want = fitted.transform(df).orderBy("k").collect()
    assert loaded.transform(df).orderBy("k").collect() == want
    assert loaded.spec == SPEC
    later = _frame(spark, offset=100)
    kept = loaded.transform(later).agg(F.avg("v")).first()[0]
    again = loaded.transform(later, refit=True).agg(F.avg("v")).first()[0]
    assert kept > 1 and abs(again) < 1e-9


def test_changelog_and_steps(spark):
    fitted = SPEC.fit(_frame(spark))
    actions = [r["action"] for r in fitted.changelog(spark).orderBy("step").collect()]
    assert actions[0].startswith("fill_") and "label" in actions and "bin_quantile" in actions
    steps = SPEC.steps(spark).collect()
    assert steps[0]["action"] == "remove_duplicates" and steps[-1]["action"] == "bin: quantile"


def test_report(spark, tmp_path):
    df = _frame(spark)
    log = cleaning.apply_cleaning(df, SPEC.clean)[1]
    tables = report_tables(df, "s", changelog=log)
    write_report(tables, str(tmp_path / "r"))
    for name in ("overview", "columns", "health", "readiness", "changelog"):
        assert spark.read.parquet(str(tmp_path / "r" / name)).count() > 0


def test_shared_folder_is_the_configured_one(spark):
    folder = spark.conf.get(session.CHECKPOINT_KEY)
    assert session.shared_dir(spark) == folder
    path = session.scratch_path(spark, "x")
    assert path.startswith(f"{folder}/x-") and path != session.scratch_path(spark, "x")


class _Bare:
    """A session that names no checkpoint folder."""

    chosen = None
    conf = property(lambda self: self)
    sparkContext = property(lambda self: self)

    def get(self, key, default=None):
        return "hdfs://w/warehouse/" if key == session.WAREHOUSE_KEY else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_shared_folder_defaults_to_the_warehouse():
    bare = _Bare()
    assert session.shared_dir(bare) == bare.chosen == "hdfs://w/warehouse/_prepflow"


# --- plan shape ---------------------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _row_level(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    series = timeseries.prepare(events, "ts", "value", ["event_id"])
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    spec = CleanSpec(True, {"o_totalprice": ColumnRule("mean", "cap")})
    return {
        "rolling": timeseries.rolling(series),
        "index": series.frame,
        "decompose": timeseries.decompose(series),
        "clean": cleaning.apply_cleaning(orders, spec)[0],
        "features": features.apply_features(
            orders, FeatureSpec(datetime={"o_orderdate": ["year"]}, encoding={"o_orderpriority": "label"}, scaling={"o_totalprice": "robust"})
        )[0],
        "pca": eda.pca(orders).scores(orders),
    }


def test_no_window_in_one_task_and_no_python(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10)  # fewer rows than a bucket holds are one
    for name, df in _row_level(spark, sf_dir).items():
        plan = _plan(df)
        lines = plan.splitlines()
        for below in (lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line):
            # only totals of partitions and one row a bucket meet in one task
            assert "partial_" in below or "HashAggregate(keys=[__bucket" in below, name
        assert "Python" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = _plan(profile.numeric_stats(lines, ["l_quantity"]))
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_filters_on_floating_columns_reach_the_scan(spark, sf_dir):
    from prepflow.sources.tables import read_parquet

    plan = _plan(read_parquet(spark, f"{sf_dir}/lineitem.parquet").where("l_discount > 0.05").select("l_orderkey"))
    assert "GreaterThan(l_discount,0.05)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_discount:double>" in plan


def test_fills_share_one_sort(spark, monkeypatch):
    rows = [(i, None if i % 3 else float(i), None if i % 4 else i) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v double, w int")
    rules = {"v": ColumnRule("ffill"), "w": ColumnRule("bfill")}
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10)
    fitted = cleaning.fit_clean(df, CleanSpec(False, rules, ("k",)))
    out = fitted.transform(df)
    plan = _plan(out)
    assert plan.count("hashpartitioning(__bucket") == 2  # the rows once, and one row a bucket
    out = out.orderBy("k").collect()
    assert [r["v"] for r in out[:5]] == [0.0, 0.0, 0.0, 3.0, 3.0] and [r["w"] for r in out[:6]] == [0, 4, 4, 4, 4, 8]


def test_hot_first_key_is_split(spark, monkeypatch):
    """Rows that share the first sort key still spread over the buckets."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 100)
    df = spark.range(20_000).selectExpr("id", "1 as t")
    ranges = ordering.cut_ranges(df, ["t", "id"])
    sizes = [r["count"] for r in df.groupBy(ranges.bucket(df)).count().collect()]
    assert len(sizes) >= 4 * 4 and max(sizes) < 20_000 / len(sizes) * 3


def test_fills_and_positions_are_lazy(spark, monkeypatch):
    """No job runs and nothing is written down when a fitted plan is applied."""
    rows = [(i, None if i % 3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v double")
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10)
    fitted = cleaning.fit_clean(df, CleanSpec(False, {"v": ColumnRule("ffill")}, ("k",)))
    assert fitted.steps[0].ranges.cuts
    monkeypatch.setattr(session, "checkpoint", None)
    for module in (ordering, cleaning):
        monkeypatch.setattr(module, "checkpoint", None, raising=False)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("apply", "apply")
    out = fitted.transform(df)
    indexed = ordering.index_rows(df, ["k"], ranges=fitted.steps[0].ranges)
    assert not tracker.getJobIdsForGroup("apply")
    assert [r["v"] for r in out.orderBy("k").collect()] == [float(i - i % 3) for i in range(300)]
    assert [r["idx"] for r in indexed.orderBy("k").collect()] == list(range(300))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_worker_functions_travel_by_value(tmp_path):
    """A worker without this package on its path can load what it is sent."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(lambda x: timeseries._lag_rows(x, 2, 1)))
    code = (
        "import numpy, pickle; f = pickle.load(open('f.pkl', 'rb')); "
        "print(f(numpy.arange(5.0)).shape)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == "(3, 4)", done.stderr
