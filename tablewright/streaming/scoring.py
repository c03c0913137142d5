"""Scoring a stream of rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.plans.model import ScoringModel, score
from tablewright.plans.serve import observed
from tablewright.sources.sinks import append_log

# Folder name and column of the number of a micro-batch.
BATCH = "batch_number"


def read_rows(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def start_scoring(
    rows: DataFrame,
    model: ScoringModel,
    path: str,
    checkpoint: str,
    clip: bool = False,
    log: str | None = None,
    project_id: int = 0,
    user_id: int = 0,
) -> StreamingQuery:
    """Score what is available, append it to parquet, then stop. The checkpoint makes reruns exactly-once.

    With a ``log`` every micro-batch leaves one entry there. Rows and entry of a
    batch lie in folders named by its number, so a batch that broke off and is
    run again replaces what it left; the log then has one entry per batch, with
    the numbers that were observed while its rows were written.
    """
    if log is None:
        writer = score(rows, model, clip).writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        stream = hashlib.md5(checkpoint.encode()).hexdigest()

        def write(batch: DataFrame, number: int) -> None:
            scored, seen = observed(score(batch, model, clip), model)
            scored.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
            if seen.get["n"]:
                append_log(batch.sparkSession, log, project_id, user_id, model.name, "stream", seen.get["n"], seen.get["c"], once=f"{stream}/{number}")

        writer = rows.writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a logged stream with the number of their batch."""
    return spark.read.parquet(path)
