"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tablewright") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return os.path.join(tempfile.gettempdir(), f"tablewright-{os.getpid()}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tablewright-{label}-{uuid.uuid4().hex}"


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go below the shared folder, unless the session names another one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read again, and the path for ``remove``."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str | None) -> None:
    """Delete a scratch table that ``written`` made, on whatever file system it lies."""
    if path is None:
        return
    if not path.startswith(f"{shared_dir(spark)}/tablewright-"):
        raise ValueError(f"not a scratch table: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def together(spark: SparkSession, *jobs: Callable, at_once: int | None = None) -> list:
    """Results of independent driver calls whose Spark jobs may run side by side, ``at_once`` of them."""
    if not jobs:
        return []
    with ThreadPool(min(at_once or len(jobs), len(jobs))) as pool:
        running = [pool.apply_async(inheritable_thread_target(spark)(job)) for job in jobs]
        return [r.get() for r in running]
