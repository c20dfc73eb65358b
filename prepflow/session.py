"""Session helpers: a default local session, and where intermediate tables live."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
WAREHOUSE_KEY = "spark.sql.warehouse.dir"
MAX_JOBS = 8


def local_session(
    cores: str = "8", app: str = "prepflow", memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """A single-JVM session for tests and the bench; ``folder`` takes checkpoints and scratch tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config(CHECKPOINT_KEY, folder) if folder else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables, on whatever file system Spark resolves it.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset it lies in the warehouse,
    which every executor reaches as well.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if not folder:
        folder = f"{spark.conf.get(WAREHOUSE_KEY).rstrip('/')}/_prepflow"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(spark: SparkSession, *jobs: Callable):
    """Results of independent actions submitted at once, so one job's tail leaves no core idle."""
    with ThreadPoolExecutor(max_workers=min(len(jobs), MAX_JOBS)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
