"""Helpers shared by the operators: written intermediate tables, folds, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Largest estimated size of a broadcast side; larger sides are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Narrow rows for which a task of its own is worth its start.
ROWS_PER_TASK = 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: computed once, whole after the loss of executors.

    At most ``batch_rows`` rows go to Python at once, which bounds the memory of wide rows on both sides.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    # the shuffle files of the write are of no use once it is done
    wanted = {_FILE_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; NULL for a NULL id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(k)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if ``rows`` (counted) times ``row_bytes`` stays under the bound, else the frame as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` (counted) narrow rows in no more partitions than they fill, but at least eight."""
    return df.coalesce(max(8, -(-rows // ROWS_PER_TASK)))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
