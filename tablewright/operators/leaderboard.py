"""Best model and run listings over the runs and model-results tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.constants import REGRESSION
from tablewright.operators.ranking import running_totals


_LOWEST = float("-inf")


def _classification_quality() -> list[Column]:
    """AUC, then F1, then accuracy; an absent metric counts as -1."""
    return [F.coalesce(c, F.lit(-1.0)) for c in ("roc_auc", "f1", "accuracy")]


def _regression_quality() -> list[Column]:
    """R², then the smaller RMSE; an absent metric ranks last."""
    return [F.coalesce("r2", F.lit(_LOWEST)), F.coalesce(-F.col("rmse"), F.lit(_LOWEST)), F.lit(0.0)]


def _per_run(results: DataFrame) -> DataFrame:
    """Number of models and both possible winners per run, combined on the map side.

    The join with the runs then meets one row per run, however many results a
    run has. The earlier result wins a tie.
    """
    first = -F.col("result_id")
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("model_count"),
        F.max_by("model_name", F.struct(*_classification_quality(), first)).alias("_classifier"),
        F.max_by("model_name", F.struct(*_regression_quality(), first)).alias("_regressor"),
    )


def _winner() -> Column:
    return F.when(F.col("problem_type") == REGRESSION, F.col("_regressor")).otherwise(F.col("_classifier"))


def best_models(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run the name of its best model."""
    joined = _per_run(results).join(runs.select("run_id", "problem_type"), "run_id")
    return joined.select("run_id", _winner().alias("best_model_name"))


def training_runs(runs: DataFrame, results: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Runs newest first with their number of models and best model; runs without results stay."""
    chosen = runs if dataset_id is None else runs.where(F.col("dataset_id") == dataset_id)
    return (
        chosen.join(_per_run(results), "run_id", "left")
        .select(
            *[F.col(c) for c in runs.columns],
            F.coalesce("model_count", F.lit(0)).alias("model_count"),
            _winner().alias("best_model_name"),
        )
        .orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    )


def run_results(results: DataFrame, run_id: int, model_name: str | None = None) -> DataFrame:
    """All results of a run in order, or the one of a model. The filter reaches the scan."""
    chosen = results.where(F.col("run_id") == run_id)
    if model_name is not None:
        chosen = chosen.where(F.col("model_name") == model_name)
    return chosen.orderBy("result_id")


def ranked_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Every result with its place within its run, from a distributed running count."""
    regression = F.col("problem_type") == REGRESSION
    keys = [
        (-F.when(regression, r).otherwise(c)).alias(f"_k{i}")
        for i, (r, c) in enumerate(zip(_regression_quality(), _classification_quality()))
    ]
    joined = results.join(runs.select("run_id", "problem_type"), "run_id").select("*", *keys)
    order = [f"_k{i}" for i in range(len(keys))] + ["result_id"]
    placed = running_totals(joined, ["run_id"], order, {"place": F.lit(1)})
    return placed.drop(*[f"_k{i}" for i in range(len(keys))]).withColumn("place", F.col("place").cast("int"))
