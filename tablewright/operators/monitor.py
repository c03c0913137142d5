"""Prediction-log analytics.

A log row: id, project_id, user_id, model_name, prediction_type, row_count,
avg_confidence, created_at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.constants import HISTORY_ROWS


def _of_project(log: DataFrame, project_id: int | None) -> DataFrame:
    return log if project_id is None else log.where(F.col("project_id") == project_id)


def prediction_history(log: DataFrame, project_id: int | None = None, limit: int = HISTORY_ROWS) -> DataFrame:
    """The newest entries; each task keeps only its own newest ones."""
    return _of_project(log, project_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def total_predictions(log: DataFrame, project_id: int | None = None) -> DataFrame:
    return _of_project(log, project_id).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_predictions"))


def model_usage(log: DataFrame, project_id: int | None = None) -> DataFrame:
    return (
        _of_project(log, project_id)
        .groupBy("model_name")
        .agg(F.sum("row_count").alias("rows_scored"), F.min("id").alias("first_id"))
    )


def most_used_model(log: DataFrame, project_id: int | None = None) -> DataFrame:
    """The model with the most scored rows, the one logged first on a tie; NULL for an empty log."""
    key = F.struct(F.col("rows_scored"), -F.col("first_id"))
    return model_usage(log, project_id).agg(F.max_by("model_name", key).alias("most_used_model"))


def average_confidence(log: DataFrame, project_id: int | None = None) -> DataFrame:
    """Unweighted mean over the entries that have a confidence."""
    return _of_project(log, project_id).agg(F.avg("avg_confidence").alias("average_confidence"))


def daily_trend(log: DataFrame, project_id: int | None = None) -> DataFrame:
    return (
        _of_project(log, project_id)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.sum("row_count").alias("count"))
        .orderBy("date")
    )


@dataclass(frozen=True)
class PredictionStats:
    total: DataFrame
    most_used: DataFrame
    confidence: DataFrame
    trend: DataFrame


def prediction_stats(log: DataFrame, project_id: int | None = None) -> PredictionStats:
    return PredictionStats(
        total_predictions(log, project_id),
        most_used_model(log, project_id),
        average_confidence(log, project_id),
        daily_trend(log, project_id),
    )


def prediction_overview(log: DataFrame, project_id: int | None = None) -> DataFrame:
    """Total, most used model, mean confidence and active days in one row and one scan.

    The log is combined per (model, day) first; confidences travel as sum and count.
    """
    cells = (
        _of_project(log, project_id)
        .groupBy("model_name", F.to_date("created_at").alias("date"))
        .agg(
            F.sum("row_count").alias("rows"),
            F.min("id").alias("first_id"),
            F.sum("avg_confidence").alias("conf"),
            F.count("avg_confidence").alias("conf_n"),
        )
    )
    # one row per model (g = 1) and one per day (g = 2)
    parts = cells.groupingSets([["model_name"], ["date"]], "model_name", "date").agg(
        F.grouping_id().alias("g"),
        F.sum("rows").alias("rows"),
        F.min("first_id").alias("first_id"),
        F.sum("conf").alias("conf"),
        F.sum("conf_n").alias("conf_n"),
    )
    of_model = lambda c: F.when(F.col("g") == 1, F.col(c))
    key = F.when(F.col("g") == 1, F.struct(F.col("rows"), -F.col("first_id")))
    return parts.agg(
        F.coalesce(F.sum(of_model("rows")), F.lit(0)).alias("total_predictions"),
        F.max_by("model_name", key).alias("most_used_model"),
        F.try_divide(F.sum(of_model("conf")), F.sum(of_model("conf_n"))).alias("average_confidence"),
        F.count_if((F.col("g") == 2) & F.col("date").isNotNull()).alias("days_active"),
    )
