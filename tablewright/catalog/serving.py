"""Files, scoring and prediction-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import r, read, rounded
from tablewright.functions.scores import argmax_index, decode_label
from tablewright.operators.monitor import (
    average_confidence,
    daily_trend,
    model_usage,
    most_used_model,
    prediction_history,
    prediction_overview,
    total_predictions,
)
from tablewright.operators.scoring import add_decision, mean_confidence
from tablewright.session import scratch_path
from tablewright.sources.csv import read_csv, read_text_csv, type_counts
from tablewright.sources.sinks import save_dataset, write_csv, write_scored
from tablewright.streaming.trend import read_event_stream, trend_once


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".csv"
    o = read(spark, sf_dir, "orders")
    write_csv(o.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))), path)
    return read_csv(spark, path)


def csv_quoted_text(spark, sf_dir):
    """Documents hold commas, quotes and line breaks."""
    path = scratch_path(spark, "documents") + ".csv"
    write_csv(read(spark, sf_dir, "documents"), path)
    back = read_csv(spark, path, multiline=True)
    return back.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"), "lang", "n_chars")


def csv_one_column(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".csv"
    write_csv(read(spark, sf_dir, "customer"), path)
    return read_csv(spark, path, columns=["c_mktsegment"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def inferred_types(spark, sf_dir):
    path = scratch_path(spark, "part") + ".csv"
    p = read(spark, sf_dir, "part")
    write_csv(
        p.select(
            "p_partkey",
            "p_name",
            F.when(F.col("p_size") != 7, F.col("p_size")).alias("gappy"),
            "p_retailprice",
            (F.col("p_size") > 25).alias("large"),
            F.when(F.col("p_size") > 40, "N/A").otherwise("12d").alias("coded"),
        ),
        path,
    )
    return type_counts(read_text_csv(spark, path))


def stored_dataset(spark, sf_dir):
    out = save_dataset(read(spark, sf_dir, "supplier"), scratch_path(spark, "supplier"))
    return out.select("rows", "columns", "duplicate_rows", F.concat_ws(",", "target_candidates").alias("candidates"))


_TYPES = ["click", "error", "purchase", "scroll", "view"]


def _decided(spark, sf_dir):
    """Embedding values as class scores."""
    e = read(spark, sf_dir, "embeddings")
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return add_decision(e.select("vec_id", scores.alias("scores")), F.col("scores"), [f"class_{i}" for i in range(10)])


def argmax_decode(spark, sf_dir):
    return _decided(spark, sf_dir).select("vec_id", "prediction", r(F.col("probability")).alias("probability"))


def whole_vector_argmax(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", decode_label(argmax_index(F.col("embedding")), None).alias("prediction"))


def confidence(spark, sf_dir):
    return rounded(mean_confidence(_decided(spark, sf_dir)), 6, ["avg_confidence"])


def scored_sink(spark, sf_dir):
    path = scratch_path(spark, "scored") + ".csv"
    write_scored(_decided(spark, sf_dir).drop("scores"), path)
    back = read_csv(spark, path)
    return back.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), r(F.sum("probability"), 4).alias("confidence"))


def _log(spark, sf_dir):
    """Events as prediction log: the type is the model, the rounded value the number of rows."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 7).alias("project_id"),
        "user_id",
        F.col("event_type").alias("model_name"),
        F.when(F.col("value") < 1, "single").otherwise("batch").alias("prediction_type"),
        F.ceil("value").alias("row_count"),
        F.when(F.col("event_type") != "error", F.least(F.lit(1.0), F.col("value") / 100)).alias("avg_confidence"),
        F.col("ts").alias("created_at"),
    )


def history(spark, sf_dir):
    return prediction_history(_log(spark, sf_dir), 3).select("id", "model_name", "prediction_type", "row_count")


def total(spark, sf_dir):
    return total_predictions(_log(spark, sf_dir))


def usage(spark, sf_dir):
    return model_usage(_log(spark, sf_dir), 2)


def most_used(spark, sf_dir):
    return most_used_model(_log(spark, sf_dir))


def average(spark, sf_dir):
    return rounded(average_confidence(_log(spark, sf_dir)), 6, ["average_confidence"])


def trend(spark, sf_dir):
    return daily_trend(_log(spark, sf_dir)).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


def overview(spark, sf_dir):
    return rounded(prediction_overview(_log(spark, sf_dir)), 6, ["average_confidence"])


def streamed_trend(spark, sf_dir):
    """The daily trend from a stream that reads everything available and ends."""
    stream = read_event_stream(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)
    log = stream.select(F.col("ts").alias("created_at"), F.ceil("value").alias("row_count"))
    return trend_once(log).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "count")


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "csv_quoted_text": csv_quoted_text,
    "csv_one_column": csv_one_column,
    "infer_types": inferred_types,
    "dataset_sink": stored_dataset,
    "argmax_decode": argmax_decode,
    "label_index": whole_vector_argmax,
    "mean_confidence": confidence,
    "scored_sink": scored_sink,
    "prediction_history": history,
    "total_predictions": total,
    "model_usage": usage,
    "most_used_model": most_used,
    "average_confidence": average,
    "daily_trend": trend,
    "prediction_stats": overview,
    "stream_daily_trend": streamed_trend,
}

_LOG_SQL = """log AS (SELECT event_id AS id, user_id % 7 AS project_id, user_id, event_type AS model_name, CASE WHEN value < 1 THEN 'single' ELSE 'batch' END AS prediction_type,
 CEIL(value)::BIGINT AS row_count, CASE WHEN event_type <> 'error' THEN LEAST(1.0, value / 100) END AS avg_confidence, ts AS created_at FROM events)"""
_BEST = """decided AS (SELECT vec_id, s, list_position(s, list_max(s)) - 1 AS i, list_max(s) AS top
 FROM (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS s FROM embeddings) t)"""

SQL = {
    "csv_round_trip": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
 NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders""",
    "csv_quoted_text": "SELECT doc_id, length(text) AS chars, md5(text) AS digest, lang, n_chars FROM documents",
    "csv_one_column": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1",
    "infer_types": """SELECT 'p_partkey' AS "column", COUNT(*) AS non_null, COUNT(*) AS integers, COUNT(*) AS numbers, 0::BIGINT AS booleans, 'bigint' AS inferred FROM part
UNION ALL SELECT 'p_name', COUNT(*), 0, 0, 0, 'string' FROM part
UNION ALL SELECT 'gappy', COUNT(*), COUNT(*), COUNT(*), 0, 'double' FROM part WHERE p_size <> 7
UNION ALL SELECT 'p_retailprice', COUNT(*), 0, COUNT(*), 0, 'double' FROM part
UNION ALL SELECT 'large', COUNT(*), 0, 0, COUNT(*), 'boolean' FROM part
UNION ALL SELECT 'coded', COUNT(*), 0, 0, 0, 'string' FROM part WHERE p_size <= 40""",
    "dataset_sink": """WITH d AS (SELECT COUNT(*) AS n, COUNT(DISTINCT s_suppkey) AS a, COUNT(DISTINCT s_name) AS b, COUNT(DISTINCT s_nationkey) AS c, COUNT(DISTINCT s_acctbal) AS e FROM supplier)
SELECT n AS rows, 4 AS columns, (n - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM supplier) x)) AS duplicate_rows,
 concat_ws(',', CASE WHEN a BETWEEN 2 AND 20 AND a <= 0.9 * n THEN 's_suppkey' END, CASE WHEN b BETWEEN 2 AND 20 AND b <= 0.9 * n THEN 's_name' END,
  CASE WHEN c BETWEEN 2 AND 20 AND c <= 0.9 * n THEN 's_nationkey' END, CASE WHEN e BETWEEN 2 AND 20 AND e <= 0.9 * n THEN 's_acctbal' END) AS candidates FROM d""",
    "argmax_decode": f"WITH {_BEST} SELECT vec_id, 'class_' || i AS prediction, round(top, 6) AS probability FROM decided",
    "label_index": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS VARCHAR) AS prediction FROM embeddings",
    "mean_confidence": f"WITH {_BEST} SELECT round(AVG(top), 6) AS avg_confidence FROM decided",
    "scored_sink": f"WITH {_BEST} SELECT 'class_' || i AS prediction, COUNT(*) AS n, round(SUM(top), 4) AS confidence FROM decided GROUP BY 1",
    "prediction_history": f"WITH {_LOG_SQL} SELECT id, model_name, prediction_type, row_count FROM log WHERE project_id = 3 ORDER BY created_at DESC, id DESC LIMIT 100",
    "total_predictions": f"WITH {_LOG_SQL} SELECT CAST(SUM(row_count) AS BIGINT) AS total_predictions FROM log",
    "model_usage": f"WITH {_LOG_SQL} SELECT model_name, CAST(SUM(row_count) AS BIGINT) AS rows_scored, MIN(id) AS first_id FROM log WHERE project_id = 2 GROUP BY 1",
    "most_used_model": f"""WITH {_LOG_SQL} SELECT model_name AS most_used_model FROM log GROUP BY 1 ORDER BY SUM(row_count) DESC, MIN(id) LIMIT 1""",
    "average_confidence": f"WITH {_LOG_SQL} SELECT round(AVG(avg_confidence), 6) AS average_confidence FROM log",
    "daily_trend": f"WITH {_LOG_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(SUM(row_count) AS BIGINT) AS count FROM log GROUP BY 1",
    "prediction_stats": f"""WITH {_LOG_SQL} SELECT CAST(SUM(row_count) AS BIGINT) AS total_predictions,
 (SELECT model_name FROM log GROUP BY 1 ORDER BY SUM(row_count) DESC, MIN(id) LIMIT 1) AS most_used_model,
 round(AVG(avg_confidence), 6) AS average_confidence, COUNT(DISTINCT created_at::DATE)::INTEGER AS days_active FROM log""",
    "stream_daily_trend": f"WITH {_LOG_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS date, CAST(SUM(row_count) AS BIGINT) AS count FROM log GROUP BY 1",
}
