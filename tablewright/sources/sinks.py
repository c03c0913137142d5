"""Dataset, scored-row and prediction-log outputs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.overview import dataset_summary

LOG_SCHEMA = (
    "id bigint, project_id bigint, user_id bigint, model_name string, prediction_type string, "
    "row_count bigint, avg_confidence double, created_at timestamp"
)


def save_dataset(df: DataFrame, path: str) -> DataFrame:
    """Store the table as parquet and report on it (from the stored copy)."""
    df.write.mode("overwrite").parquet(path)
    return dataset_summary(df.sparkSession.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header in each, quotes doubled, missing values empty."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "nullValue", ""
    ).option("emptyValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)


def write_scored(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scored rows: the input columns with prediction and probability."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def append_log(
    spark: SparkSession,
    path: str,
    project_id: int,
    user_id: int,
    model_name: str,
    prediction_type: str,
    row_count: int,
    avg_confidence: float | None,
    created_at: datetime | None = None,
    once: str | None = None,
) -> None:
    """Append one entry. The time in microseconds serves as id, so that appending needs no look at the log.

    ``once`` names the entry: written again under the same name, it replaces the one before.
    """
    when = created_at or datetime.now(timezone.utc)
    entry = spark.createDataFrame(
        [(int(when.timestamp() * 1_000_000), project_id, user_id, model_name, prediction_type, row_count, avg_confidence, when)], LOG_SCHEMA
    ).coalesce(1)
    if once is None:
        entry.write.mode("append").parquet(path)
    else:
        entry.write.mode("overwrite").parquet(f"{path}/{once}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries, those of named folders included."""
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).parquet(path)
