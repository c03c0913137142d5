"""Queries over models that are stored, found again, promoted, explained and used on streams, and suites on planted rules."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tablewright.catalog.tables import r, read
from tablewright.catalog.training import _PRICED_SQL
from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.operators.leaderboard import best_models, run_results
from tablewright.operators.target import Target
from tablewright.plans.explain import explain_position
from tablewright.plans.model import load_promoted, promote_model, promote_saved, promoted_path, promotions
from tablewright.plans.preprocess import preprocess
from tablewright.plans.training import append_experiment, load_result, read_experiments, run_suite
from tablewright.session import scratch_path
from tablewright.sources.sinks import read_log
from tablewright.streaming.scoring import read_rows, start_scoring

POSITION = 7
_KINDS = ("logistic_regression", "random_forest", "gbt_fast")


def _priced_run(spark, sf_dir):
    """A stored run of the least-squares model of part prices, read back from its folder."""
    target = Target("p_retailprice", REGRESSION)
    df = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    prepared = preprocess(df, target, ["p_partkey"], exclude=["p_partkey"])
    folder = scratch_path(spark, "experiments")
    append_experiment(run_suite(prepared, target, names=["linear_regression"], run_id=11, folder=folder), folder)
    return df, prepared, folder, *read_experiments(spark, folder)


def model_versions(spark, sf_dir):
    """Train and store, promote another model and then the stored one, explain the row at a position with what is promoted."""
    df, prepared, folder, _, results = _priced_run(spark, sf_dir)
    stored = load_result(spark, results, 11, "linear_regression")
    other = run_suite(prepared, stored.target, names=["linear_regression"]).models["linear_regression"]
    promote_model(spark, other, folder, 3)
    promote_saved(spark, stored.path, folder, 3)
    found = explain_position(prepared.split.test(df), load_promoted(spark, folder, 3), ["p_partkey"], POSITION)
    top = F.element_at("contributions", 1)
    return found.select(
        F.lit(promotions(spark, folder, 3).count()).alias("promotions"),
        F.lit(promoted_path(spark, folder, 3) == stored.path).alias("is_stored"),
        "p_partkey",
        r(F.col("base_value"), 4).alias("base_value"),
        r(F.col("predicted_value"), 4).alias("predicted_value"),
        r(top.getField("shap_value"), 4).alias("shap_value"),
    )


def experiment_results(spark, sf_dir):
    """Metrics, settings and best model of a stored run."""
    _, _, _, runs, results = _priced_run(spark, sf_dir)
    found = run_results(results, 11, "linear_regression").join(best_models(runs, results), "run_id")
    return found.select(
        "run_id",
        "model_name",
        "best_model_name",
        *[r(F.col(c), 4).alias(c) for c in ("mae", "rmse", "r2")],
        F.element_at("params", "maxIter").alias("max_iter"),
        (F.col("training_time_seconds") > 0).alias("timed"),
        F.col("accuracy").isNull().alias("no_accuracy"),
    )


def stream_prediction_log(spark, sf_dir):
    """A stream scored twice over the same checkpoint: its rows and its log entries are there once."""
    df, _, _, _, results = _priced_run(spark, sf_dir)
    model = load_result(spark, results, 11, "linear_regression")
    out, log, checkpoint = (scratch_path(spark, x) for x in ("scored", "log", "checkpoint"))
    for _ in range(2):
        rows = read_rows(spark, sf_dir, read(spark, sf_dir, "part").schema, pattern="part.parquet").select(*df.columns)
        start_scoring(rows, model, out, checkpoint, log=log, project_id=5, user_id=6).awaitTermination()
    scored = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("scored_rows"), r(F.avg("prediction"), 4).alias("mean_prediction"))
    entries = read_log(spark, log).select("project_id", "user_id", "model_name", "prediction_type", "row_count", F.col("avg_confidence").isNull().alias("no_confidence"))
    return entries.crossJoin(F.broadcast(scored))  # one entry, one row of totals


def _planted(spark, sf_dir, problem_type):
    """Orders with a target that a rule on the price gives, so every model of the suite can learn it."""
    price = F.col("o_totalprice")
    rule = {
        BINARY: F.when(price > 200_000, "high").otherwise("low"),
        MULTICLASS: F.when(price < 100_000, "a").when(price < 250_000, "b").otherwise("c"),
        REGRESSION: 50_000 * F.floor(price / 50_000),
    }[problem_type]
    df = read(spark, sf_dir, "orders").withColumn("planted", rule)
    target = Target("planted", problem_type)
    return target, preprocess(df, target, ["o_orderkey"], exclude=["o_orderkey"])


def planted_suite(problem_type, spark, sf_dir, names=None):
    """Whether each model of the suite has learnt the rule, at the library's default size."""
    target, prepared = _planted(spark, sf_dir, problem_type)
    results = run_suite(prepared, target, names=names).results
    quality = F.least("accuracy", "f1", "roc_auc") if target.is_classification else F.col("r2")
    return results.select("model_name", (quality > 0.9).alias("learnt"), (F.col("training_time_seconds") > 0).alias("timed"))


QUERIES = {
    "model_versions": model_versions,
    "experiment_results": experiment_results,
    "stream_prediction_log": stream_prediction_log,
    "planted_suite_binary": partial(planted_suite, BINARY),
    # one model of each kind; train_suite_multiclass trains all three settings of boosting
    "planted_models_multiclass": partial(planted_suite, MULTICLASS, names=_KINDS),
    "planted_suite_regression": partial(planted_suite, REGRESSION),
}


_ALL = ("random_forest", "gbt_fast", "gbt_leaf", "gbt_slow")


def _learnt(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS model_name, TRUE AS learnt, TRUE AS timed" for n in names)


SQL = {
    "model_versions": f"""WITH {_PRICED_SQL} SELECT 2 AS promotions, TRUE AS is_stored, p_partkey, round(a + b * mu, 4) AS base_value,
 round(a + b * p_size, 4) AS predicted_value, round(b * (p_size - mu), 4) AS shap_value FROM marked, fit WHERE is_test ORDER BY p_partkey LIMIT 1 OFFSET {POSITION}""",
    "experiment_results": f"""WITH {_PRICED_SQL}, t AS (SELECT p_retailprice AS y, a + b * p_size AS q FROM marked, fit WHERE is_test)
SELECT 11::BIGINT AS run_id, 'linear_regression' AS model_name, 'linear_regression' AS best_model_name, round(AVG(ABS(y - q)), 4) AS mae,
 round(SQRT(AVG((y - q) * (y - q))), 4) AS rmse, round(1 - SUM((y - q) * (y - q)) / SUM((y - (SELECT AVG(y) FROM t)) * (y - (SELECT AVG(y) FROM t))), 4) AS r2,
 '1000' AS max_iter, TRUE AS timed, TRUE AS no_accuracy FROM t""",
    "stream_prediction_log": f"""WITH {_PRICED_SQL} SELECT 5::BIGINT AS project_id, 6::BIGINT AS user_id, 'linear_regression' AS model_name, 'stream' AS prediction_type,
 COUNT(*) AS row_count, TRUE AS no_confidence, COUNT(*) AS scored_rows, round(AVG(a + b * p_size), 4) AS mean_prediction FROM marked, fit""",
    "planted_suite_binary": _learnt("logistic_regression", *_ALL),
    "planted_models_multiclass": _learnt(*_KINDS),
    "planted_suite_regression": _learnt("linear_regression", *_ALL),
}
