"""Metric, leaderboard and attribution queries, and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import r, read, rounded
from tablewright.functions.values import as_double
from tablewright.operators.attribution import (
    contribution_list,
    feature_means,
    linear_base,
    linear_shap,
    mean_absolute,
    top_contributions,
)
from tablewright.operators.leaderboard import best_models, ranked_results, training_runs
from tablewright.operators.metrics import (
    binary_roc_auc,
    classification_metrics,
    ovr_roc_auc,
    regression_metrics,
)


def _predictions(spark, sf_dir):
    """Formula predictions, so that both engines judge the same rows."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("y_true"),
        (F.col("l_quantity") > 25).cast("int").alias("y_pred"),
        F.col("l_discount").alias("score"),
        F.col("l_extendedprice").alias("fine_score"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_tax") < 0.03, "A").when(F.col("l_tax") < 0.06, "N").otherwise("X").alias("flag_pred"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cls"),
        "l_quantity",
        "l_tax",
    )


def binary_metrics(spark, sf_dir):
    out = classification_metrics(_predictions(spark, sf_dir), positive=1)
    return rounded(out, 6, out.columns)


def weighted_metrics(spark, sf_dir):
    out = classification_metrics(_predictions(spark, sf_dir), "flag", "flag_pred")
    return rounded(out, 6, out.columns)


def auc_ties(spark, sf_dir):
    return rounded(binary_roc_auc(_predictions(spark, sf_dir)), 6, ["roc_auc"])


def auc_fine(spark, sf_dir):
    return rounded(binary_roc_auc(_predictions(spark, sf_dir), score="fine_score"), 6, ["roc_auc"])


def auc_ovr(spark, sf_dir):
    df = _predictions(spark, sf_dir)
    scores = F.array(F.col("score"), F.col("l_quantity") / 50, F.col("l_tax"))
    return rounded(ovr_roc_auc(df, "cls", scores, 3), 6, ["roc_auc"])


def regression_quality(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y_true"), (F.col("o_custkey") + 100000).alias("y_pred"))
    return rounded(regression_metrics(df), 5, ["mae", "rmse", "r2"])


def _runs(spark, sf_dir):
    """Runs and results read off the tables: an order is a run, its line items are model results."""
    orders = read(spark, sf_dir, "orders")
    runs = orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.pmod("o_custkey", F.lit(50)).alias("dataset_id"),
        F.when(F.col("o_orderstatus") == "F", "regression").when(F.col("o_orderstatus") == "O", "binary_classification").otherwise("multiclass_classification").alias("problem_type"),
        F.col("o_orderdate").alias("created_at"),
    )
    li = read(spark, sf_dir, "lineitem")
    # several rows share (order, line); the one with the smallest part key stands for the result
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by(F.struct("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_suppkey"), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("v")
    )
    results = lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").cast("bigint").alias("result_id"),
        F.concat(F.lit("model_"), F.col("l_linenumber").cast("string")).alias("model_name"),
        F.nullif(F.col("v.l_discount"), F.lit(0.0)).alias("roc_auc"),
        F.nullif(F.col("v.l_tax"), F.lit(0.0)).alias("f1"),
        (F.col("v.l_quantity") / 50).alias("accuracy"),
        F.nullif(F.col("v.l_quantity"), F.lit(10.0)).alias("r2"),
        F.col("v.l_extendedprice").alias("rmse"),
    )
    return runs, results


def best_model(spark, sf_dir):
    return best_models(*_runs(spark, sf_dir))


def run_listing(spark, sf_dir):
    return training_runs(*_runs(spark, sf_dir))


def run_ranking(spark, sf_dir):
    return ranked_results(*_runs(spark, sf_dir)).select("run_id", "model_name", "place")


# Many digits, so that no contribution sits on a rounding boundary.
_WEIGHTS = {"l_quantity": 0.517283947, "l_extendedprice": -0.001037461, "l_discount": 12.037193, "l_tax": -7.519373}
_INTERCEPT = 0.250917


def _shap(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    values = {n: as_double(li, n) for n in _WEIGHTS}
    means = feature_means(li, values)
    return li, values, linear_shap(values, _WEIGHTS, means), linear_base(_WEIGHTS, means, _INTERCEPT)


def linear_contributions(spark, sf_dir):
    li, _, phi, base = _shap(spark, sf_dir)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[r(c, 5).alias(f"phi_{n}") for n, c in phi.items()], r(F.lit(base), 5).alias("base_value"))


def importance(spark, sf_dir):
    li, _, phi, _ = _shap(spark, sf_dir)
    return rounded(mean_absolute(li, phi), 5, ["mean_abs_shap"])


def strongest(spark, sf_dir):
    li, values, phi, _ = _shap(spark, sf_dir)
    names = list(values)
    listed = contribution_list(list(values.values()), list(phi.values()), names)
    top = li.select("l_orderkey", "l_linenumber", "l_partkey", top_contributions(listed, 2).alias("top"))
    return top.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.element_at("top", 1).getField("feature").alias("first_feature"),
        r(F.element_at("top", 1).getField("shap_value"), 4).alias("first_shap"),
        r(F.element_at("top", 2).getField("bar_width"), 3).alias("second_bar"),
    )


QUERIES = {
    "classification_metrics": binary_metrics,
    "weighted_metrics": weighted_metrics,
    "roc_auc_binary": auc_ties,
    "roc_auc_fine_scores": auc_fine,
    "roc_auc_ovr": auc_ovr,
    "regression_metrics": regression_quality,
    "best_model": best_model,
    "leaderboard": run_listing,
    "result_ranking": run_ranking,
    "linear_shap": linear_contributions,
    "shap_importance": importance,
    "top_contributions": strongest,
}

_PRED_SQL = """pred AS (SELECT (l_linestatus = 'O')::INT AS y_true, (l_quantity > 25)::INT AS y_pred, l_discount AS score, l_extendedprice AS fine_score,
 l_returnflag AS flag, CASE WHEN l_tax < CAST(0.03 AS DOUBLE) THEN 'A' WHEN l_tax < CAST(0.06 AS DOUBLE) THEN 'N' ELSE 'X' END AS flag_pred,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, l_quantity, l_tax FROM lineitem)"""


def _auc_sql(score: str, positive: str) -> str:
    """Mann-Whitney with mid-ranks: average rank of tied scores."""
    return f"""(SELECT (SUM(CASE WHEN p THEN rk END) - SUM(p::INT)::DOUBLE * (SUM(p::INT) + 1) / 2) / (SUM(p::INT)::DOUBLE * SUM((NOT p)::INT))
 FROM (SELECT p, rank() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM (SELECT {score} AS s, {positive} AS p FROM pred) a) b)"""


_RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey % 50 AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'regression' WHEN 'O' THEN 'binary_classification'
 ELSE 'multiclass_classification' END AS problem_type, o_orderdate AS created_at FROM orders),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
results AS (SELECT l_orderkey AS run_id, l_linenumber::BIGINT AS result_id, 'model_' || l_linenumber AS model_name, NULLIF(l_discount, 0) AS roc_auc, NULLIF(l_tax, 0) AS f1,
 l_quantity / 50 AS accuracy, NULLIF(l_quantity, 10) AS r2, l_extendedprice AS rmse FROM lines WHERE rn = 1),
ranked AS (SELECT s.run_id, model_name, row_number() OVER (PARTITION BY s.run_id ORDER BY
  CASE WHEN problem_type = 'regression' THEN COALESCE(r2, '-infinity'::DOUBLE) ELSE COALESCE(roc_auc, -1) END DESC,
  CASE WHEN problem_type = 'regression' THEN COALESCE(-rmse, '-infinity'::DOUBLE) ELSE COALESCE(f1, -1) END DESC,
  CASE WHEN problem_type = 'regression' THEN 0 ELSE COALESCE(accuracy, -1) END DESC, result_id) AS place FROM results s JOIN runs USING (run_id))"""

_SHAP_SQL = "mu AS (SELECT " + ", ".join(f"AVG({n}) AS {n}" for n in _WEIGHTS) + " FROM lineitem)"
_PHI = {n: f"(l.{n} - mu.{n}) * ({w})::DOUBLE" for n, w in _WEIGHTS.items()}

SQL = {
    "classification_metrics": f"""WITH {_PRED_SQL}, c AS (SELECT SUM((y_true = 1 AND y_pred = 1)::INT)::DOUBLE AS hit, SUM((y_pred = 1)::INT) AS said, SUM((y_true = 1)::INT) AS real,
 SUM((y_true = y_pred)::INT)::DOUBLE AS ok, COUNT(*) AS n FROM pred)
SELECT round(ok / n, 6) AS accuracy, round(hit / said, 6) AS precision, round(hit / real, 6) AS recall, round(2 * hit / (said + real), 6) AS f1 FROM c""",
    "weighted_metrics": f"""WITH {_PRED_SQL}, k AS (SELECT flag AS v FROM pred UNION SELECT flag_pred FROM pred),
 c AS (SELECT v, (SELECT COUNT(*) FROM pred WHERE flag = v)::DOUBLE AS real, (SELECT COUNT(*) FROM pred WHERE flag_pred = v)::DOUBLE AS said,
  (SELECT COUNT(*) FROM pred WHERE flag = v AND flag_pred = v)::DOUBLE AS hit FROM k)
SELECT round(SUM(hit) / SUM(real), 6) AS accuracy, round(SUM(CASE WHEN said > 0 THEN hit / said ELSE 0 END * real) / SUM(real), 6) AS precision,
 round(SUM(CASE WHEN real > 0 THEN hit / real ELSE 0 END * real) / SUM(real), 6) AS recall, round(SUM(CASE WHEN said + real > 0 THEN 2 * hit / (said + real) ELSE 0 END * real) / SUM(real), 6) AS f1 FROM c""",
    "roc_auc_binary": f"WITH {_PRED_SQL} SELECT round({_auc_sql('score', 'y_true = 1')}, 6) AS roc_auc",
    "roc_auc_fine_scores": f"WITH {_PRED_SQL} SELECT round({_auc_sql('fine_score', 'y_true = 1')}, 6) AS roc_auc",
    "roc_auc_ovr": f"""WITH {_PRED_SQL} SELECT round(({_auc_sql("score", "cls = 0")} * (SELECT COUNT(*) FROM pred WHERE cls = 0)
 + {_auc_sql("l_quantity / 50", "cls = 1")} * (SELECT COUNT(*) FROM pred WHERE cls = 1)
 + {_auc_sql("l_tax", "cls = 2")} * (SELECT COUNT(*) FROM pred WHERE cls = 2)) / (SELECT COUNT(*) FROM pred), 6) AS roc_auc""",
    "regression_metrics": """WITH p AS (SELECT o_totalprice AS y, o_custkey + 100000 AS q FROM orders)
SELECT round(AVG(ABS(y - q)), 5) AS mae, round(SQRT(AVG((y - q) * (y - q))), 5) AS rmse,
 round(1 - SUM((y - q) * (y - q)) / SUM((y - (SELECT AVG(y) FROM p)) * (y - (SELECT AVG(y) FROM p))), 5) AS r2 FROM p""",
    "best_model": f"WITH {_RUNS_SQL} SELECT run_id, model_name AS best_model_name FROM ranked WHERE place = 1",
    "leaderboard": f"""WITH {_RUNS_SQL} SELECT runs.*, COALESCE(c.n, 0) AS model_count, b.model_name AS best_model_name FROM runs
 LEFT JOIN (SELECT run_id, COUNT(*) AS n FROM results GROUP BY 1) c USING (run_id) LEFT JOIN (SELECT * FROM ranked WHERE place = 1) b USING (run_id)""",
    "result_ranking": f"WITH {_RUNS_SQL} SELECT run_id, model_name, place::INTEGER AS place FROM ranked",
    "linear_shap": f"""WITH {_SHAP_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"round({e}, 5) AS phi_{n}" for n, e in _PHI.items())},
 round({_INTERCEPT} + {" + ".join(f"mu.{n} * ({w})::DOUBLE" for n, w in _WEIGHTS.items())}, 5) AS base_value FROM lineitem l, mu""",
    "shap_importance": f"WITH {_SHAP_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(AVG(ABS({e})), 5) AS mean_abs_shap FROM lineitem l, mu" for n, e in _PHI.items()),
    "top_contributions": f"""WITH {_SHAP_SQL}, listed AS (SELECT l_orderkey, l_linenumber, l_partkey,
 list_sort([{", ".join(f"struct_pack(k := -ABS({e}), i := {i}, feature := '{n}', v := {e})" for i, (n, e) in enumerate(_PHI.items()))}]) AS s FROM lineitem l, mu)
SELECT l_orderkey, l_linenumber, l_partkey, s[1].feature AS first_feature, round(s[1].v, 4) AS first_shap,
 round(ABS(s[2].v) / GREATEST(ABS(s[1].v), CAST(0.0001 AS DOUBLE)) * 100, 3) AS second_bar FROM listed""",
}
