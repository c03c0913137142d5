"""Profiling, preparation, modelling, explanation and scoring of tables on Spark."""

from tablewright.operators.leaderboard import best_models, run_results, training_runs
from tablewright.operators.metrics import (
    binary_roc_auc,
    classification_metrics,
    ovr_roc_auc,
    regression_metrics,
)
from tablewright.operators.monitor import prediction_history, prediction_overview, prediction_stats
from tablewright.operators.overview import dataset_summary, target_candidates
from tablewright.operators.target import Target, analyze_target, assign_target, require_target
from tablewright.plans.engineer import engineer_features
from tablewright.plans.explain import explain_position, explain_rows, shap_summary
from tablewright.plans.model import ScoringModel, load_promoted, promote_model, promote_saved, promotions, saved_model_info, score
from tablewright.plans.preprocess import preprocess
from tablewright.plans.profile import profile
from tablewright.plans.serve import score_batch
from tablewright.plans.training import SuiteOptions, append_experiment, load_result, read_experiments, run_suite
from tablewright.sources.csv import read_csv
from tablewright.sources.sinks import append_log, read_log, save_dataset, write_scored
from tablewright.streaming.scoring import start_scoring
from tablewright.streaming.trend import read_trend, start_trend_sink, start_trend_upsert, streaming_trend

__all__ = [
    "ScoringModel",
    "SuiteOptions",
    "Target",
    "analyze_target",
    "append_experiment",
    "append_log",
    "assign_target",
    "best_models",
    "binary_roc_auc",
    "classification_metrics",
    "dataset_summary",
    "engineer_features",
    "explain_position",
    "explain_rows",
    "load_promoted",
    "load_result",
    "ovr_roc_auc",
    "prediction_history",
    "prediction_overview",
    "prediction_stats",
    "preprocess",
    "profile",
    "promote_model",
    "promote_saved",
    "promotions",
    "read_csv",
    "read_experiments",
    "read_log",
    "read_trend",
    "regression_metrics",
    "require_target",
    "run_results",
    "run_suite",
    "save_dataset",
    "saved_model_info",
    "score",
    "score_batch",
    "shap_summary",
    "start_scoring",
    "start_trend_sink",
    "start_trend_upsert",
    "streaming_trend",
    "target_candidates",
    "training_runs",
    "write_scored",
]
