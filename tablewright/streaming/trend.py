"""Daily trend over a stream of prediction-log entries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.session import scratch_path

LATENESS = "1 day"


def read_event_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """Parquet files of a folder as a stream; ``pattern`` selects by file name."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def streaming_trend(log: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Rows scored per day. State holds the days that may still change, one row per day and partition."""
    timed = log.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", lateness)
    daily = timed.groupBy(F.window("_at", "1 day")).agg(F.sum("row_count").alias("count"))
    return daily.select(F.to_date(F.col("window.start")).alias("date"), "count")


def start_trend_sink(log: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Appends each day to parquet once the watermark has passed it."""
    return (
        streaming_trend(log, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_trend_upsert(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the trend of all days up to date in ``path``, a folder per day, however late a row comes.

    A batch replaces the folders of its days only. A day remembers the batch that
    changed it last and its count before, so a batch that broke off half-way and
    runs again adds to each day once. Only the days of a batch reach the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = batch.groupBy(F.to_date("created_at").alias("date")).agg(F.sum("row_count").alias("n")).where("date IS NOT NULL")
        new = {r["date"]: r["n"] or 0 for r in days.collect()}
        if not new:
            return
        rows = []
        held = {r["date"]: r for r in _held(spark, path).where(F.col("date").isin(list(new))).collect()}
        for day, n in new.items():
            old = held.get(day)
            before = 0 if old is None else old["before"] if old["batch"] == number else old["count"]
            rows.append((day, before + n, before, number))
        frame = spark.createDataFrame(rows, _TREND).repartition("date")
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_TREND = "date date, count bigint, before bigint, batch bigint"


def _held(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_TREND).option("basePath", path).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], _TREND)


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """Rows scored per day, as of the last finished batch."""
    return _held(spark, path).select("date", "count")


def trend_once(log: DataFrame) -> DataFrame:
    """Consume what is available and return the trend of all days, open ones included."""
    spark = log.sparkSession
    path = scratch_path(spark, "trend-days")
    start_trend_upsert(log, path, scratch_path(spark, "trend")).awaitTermination()
    return read_trend(spark, path)
