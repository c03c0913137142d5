"""Profiling and target queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import LINEITEM_GAPS_SQL, ORDERS_GAPS_SQL, lineitem_gaps, orders_gaps, r, read, rounded
from tablewright.functions.kinds import numeric_columns
from tablewright.operators.columns import categorical_stats, categorical_top_values, numeric_stats
from tablewright.operators.correlation import correlation_matrix
from tablewright.operators.distribution import boxplots, histograms
from tablewright.operators.overview import (
    duplicate_count,
    missing_only,
    missing_values,
    shape,
    size_estimate,
    small_cardinalities,
    target_candidates,
)
from tablewright.operators.sampling import sample_rows
from tablewright.operators.target import class_distribution, detect_problem_type, regression_summary
from tablewright.plans.profile import column_profile, profile

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_NUMERIC = LINEITEM[:8]


def table_shape(spark, sf_dir):
    return shape(lineitem_gaps(spark, sf_dir))


def missing(spark, sf_dir):
    return missing_values(lineitem_gaps(spark, sf_dir)).select("column", "missing_count", "missing_pct")


def missing_columns(spark, sf_dir):
    return missing_only(missing_values(orders_gaps(spark, sf_dir))).select("column", "missing_count", "missing_pct")


def duplicate_rows(spark, sf_dir):
    return duplicate_count(read(spark, sf_dir, "documents").drop("doc_id"))


def duplicate_whole_rows(spark, sf_dir):
    return duplicate_count(lineitem_gaps(spark, sf_dir).select("l_suppkey", "l_quantity", "l_returnflag"), whole_rows=True)


_STATS = ["mean", "median", "mode", "min", "max", "std"]


def numeric_statistics(spark, sf_dir):
    return rounded(numeric_stats(lineitem_gaps(spark, sf_dir)), 6, _STATS)


def categorical_statistics(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_name", "p_brand", F.nullif("p_type", F.lit("ECONOMY")).alias("p_type"))
    return categorical_stats(df)


def categorical_top(spark, sf_dir):
    return categorical_top_values(lineitem_gaps(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_shipdate"))


def correlation_wide(spark, sf_dir):
    return rounded(correlation_matrix(lineitem_gaps(spark, sf_dir)), 6, ["corr"])


def correlation_few(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(
        "p_size", F.when(F.col("p_size") > 3, F.col("p_retailprice")).alias("price"), F.lit(1.0).alias("constant")
    )
    return rounded(correlation_matrix(df), 6, ["corr"])


def correlation_far(spark, sf_dir):
    a = F.when(F.col("l_orderkey") > 1000, F.col("l_orderkey") + 1.7e9)
    df = read(spark, sf_dir, "lineitem").select(a.alias("a"), (2 * a + 1).alias("b"), "l_quantity", "l_extendedprice")
    return rounded(correlation_matrix(df), 6, ["corr"])


def histogram(spark, sf_dir):
    return histograms(lineitem_gaps(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_discount", "l_suppkey"))


def boxplot(spark, sf_dir):
    out = boxplots(lineitem_gaps(spark, sf_dir))
    return rounded(out, 6, [c for c in out.columns if c != "column"])


def row_sample(spark, sf_dir):
    return sample_rows(read(spark, sf_dir, "events").drop("ts"), ["event_id"])


def memory_estimate(spark, sf_dir):
    return size_estimate(read(spark, sf_dir, "documents"))


def candidates(spark, sf_dir):
    names = target_candidates(lineitem_gaps(spark, sf_dir))
    return spark.createDataFrame([(n,) for n in names], "column string")


def bounded_cardinality(spark, sf_dir):
    df = lineitem_gaps(spark, sf_dir)
    counts = small_cardinalities(df, df.columns, 20)
    return spark.createDataFrame(list(counts.items()), "column string, distinct_values bigint")


def problem_types(spark, sf_dir):
    df = lineitem_gaps(spark, sf_dir)
    names = numeric_columns(df) + ["l_returnflag", "l_linestatus"]
    return spark.createDataFrame([(n, detect_problem_type(df, n)) for n in names], "column string, problem_type string")


def classes(spark, sf_dir):
    return class_distribution(orders_gaps(spark, sf_dir), "o_orderpriority")


def regression_target(spark, sf_dir):
    out = regression_summary(orders_gaps(spark, sf_dir), "o_totalprice")
    return out.select(*[r(F.col(c)).alias(c) for c in out.columns])


def full_profile(spark, sf_dir):
    out = column_profile(profile(orders_gaps(spark, sf_dir), ["o_orderkey"]))
    return rounded(out, 6, ["mean", "median", "mode_number", "min", "max", "std"])


def sample_of_copies(spark, sf_dir):
    """A sample of a table of five contents, without a key: all five come up, in a sample of its full size."""
    found = sample_rows(read(spark, sf_dir, "events").select("event_type"))
    return found.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_type").alias("contents"))


QUERIES = {
    "table_shape": table_shape,
    "missing_values": missing,
    "missing_columns": missing_columns,
    "duplicate_rows": duplicate_rows,
    "duplicate_whole_rows": duplicate_whole_rows,
    "numeric_stats": numeric_statistics,
    "categorical_stats": categorical_statistics,
    "top_values": categorical_top,
    "correlation_matrix": correlation_wide,
    "correlation_few_columns": correlation_few,
    "correlation_far_from_zero": correlation_far,
    "histogram": histogram,
    "boxplot": boxplot,
    "sample_rows": row_sample,
    "sample_of_copies": sample_of_copies,
    "size_estimate": memory_estimate,
    "target_candidates": candidates,
    "bounded_cardinality": bounded_cardinality,
    "problem_type": problem_types,
    "class_distribution": classes,
    "regression_summary": regression_target,
    "profile": full_profile,
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _missing_sql(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing_count, "
            f"COALESCE(round_even((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / NULLIF(COUNT(*), 0), 2), 0.0) AS missing_pct FROM {table}"
            for c in columns
        ]
    )


def _mode_sql(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"


def _numeric_sql(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
 COALESCE(round_even((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / NULLIF(COUNT(*), 0), 2), 0.0) AS missing_pct,
 round(AVG({c}::DOUBLE), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
 round(MIN({c})::DOUBLE, 6) AS min, round(MAX({c})::DOUBLE, 6) AS max, round(stddev_samp({c}::DOUBLE), 6) AS std,
 round({_mode_sql(table, c)}::DOUBLE, 6) AS mode FROM {table}"""
            for c in columns
        ]
    )


def _categorical_sql(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
 COALESCE(round_even((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / NULLIF(COUNT(*), 0), 2), 0.0) AS missing_pct,
 CAST({_mode_sql(table, c)} AS VARCHAR) AS mode, COUNT(DISTINCT {c}) AS unique_count FROM {table}"""
            for c in columns
        ]
    )


def _corr_sql(table: str, columns: list[str]) -> str:
    # the same coefficient from pair-wise complete rows; a constant side gives NULL
    parts = []
    for a in columns:
        for b in columns:
            parts.append(
                f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
 round(CASE WHEN var_pop({a}::DOUBLE) FILTER (WHERE {b} IS NOT NULL) > 0
             AND var_pop({b}::DOUBLE) FILTER (WHERE {a} IS NOT NULL) > 0
            THEN corr({a}::DOUBLE, {b}::DOUBLE) END, 6) AS corr FROM {table}"""
            )
    return _union(parts)


def _hist_sql(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"""SELECT '{c}' AS "column", b.bin::INTEGER AS bin,
 round(e.lo + (b.bin - 1) * e.w, 4) AS lo,
 round(CASE WHEN b.bin = 10 THEN e.hi ELSE e.lo + b.bin * e.w END, 4) AS hi,
 (SELECT COUNT(*) FROM {table} WHERE {c} >= e.lo + (b.bin - 1) * e.w
    AND (b.bin = 10 OR {c} < e.lo + b.bin * e.w)) AS count
 FROM (SELECT MIN({c})::DOUBLE AS lo, MAX({c})::DOUBLE AS hi, (MAX({c})::DOUBLE - MIN({c})::DOUBLE) / 10 AS w FROM {table}) e,
      (SELECT UNNEST(range(1, 11)) AS bin) b
 WHERE e.lo < e.hi"""
            for c in columns
        ]
    )


def _box_sql(table: str, columns: list[str]) -> str:
    return _union(
        [
            f"""SELECT "column", round(mn, 6) AS min, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(mx, 6) AS max,
 round(GREATEST(mn, q1 - 1.5 * (q3 - q1)), 6) AS lower_whisker, round(LEAST(mx, q3 + 1.5 * (q3 - q1)), 6) AS upper_whisker
 FROM (SELECT '{c}' AS "column", MIN({c})::DOUBLE AS mn, MAX({c})::DOUBLE AS mx, quantile_cont({c}::DOUBLE, 0.25) AS q1,
 quantile_cont({c}::DOUBLE, 0.5) AS q2, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table}) t"""
            for c in columns
        ]
    )


def _top_sql(table: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    ]
    return f"""SELECT "column", rank::INTEGER AS rank, value, count FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({_union(parts)}) f) g WHERE rank <= 10"""


def _distinct_sql(table: str, columns: list[str]) -> str:
    return _union([f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS d, COUNT(*) AS n FROM {table}" for c in columns])


_DOCS_TEXT = "COALESCE(octet_length(encode(text)), 0) + COALESCE(octet_length(encode(lang)), 0) + COALESCE(octet_length(encode(source)), 0)"

_PROFILE_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
_PROFILE_TEXT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
_NULL = "CAST(NULL AS DOUBLE)"

SQL = {
    "table_shape": f"""WITH {LINEITEM_GAPS_SQL}, m AS ({_missing_sql("gaps", LINEITEM)})
SELECT (SELECT COUNT(*) FROM gaps) AS rows, 11 AS columns, 8 AS numeric_columns, 3 AS categorical_columns,
 round_even(SUM(missing_count)::DOUBLE / ((SELECT COUNT(*) FROM gaps) * 11) * 100, 2) AS missing_values_pct FROM m""",
    "missing_values": f"WITH {LINEITEM_GAPS_SQL} {_missing_sql('gaps', LINEITEM)}",
    "missing_columns": f"""WITH {ORDERS_GAPS_SQL}, m AS ({_missing_sql("gaps", _PROFILE_NUMERIC + _PROFILE_TEXT)})
SELECT * FROM m WHERE missing_count > 0""",
    "duplicate_rows": """SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
 (SELECT COUNT(*) AS n FROM documents GROUP BY text, lang, source, n_chars) g""",
    "duplicate_whole_rows": f"""WITH {LINEITEM_GAPS_SQL} SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
 (SELECT COUNT(*) AS n FROM gaps GROUP BY l_suppkey, l_quantity, l_returnflag) g""",
    "numeric_stats": f"WITH {LINEITEM_GAPS_SQL} {_numeric_sql('gaps', LINEITEM_NUMERIC)}",
    "categorical_stats": f"""WITH p AS (SELECT p_name, p_brand, NULLIF(p_type, 'ECONOMY') AS p_type FROM part)
{_categorical_sql("p", ["p_name", "p_brand", "p_type"])}""",
    "top_values": f"WITH {LINEITEM_GAPS_SQL} {_top_sql('gaps', ['l_returnflag', 'l_linestatus', 'l_shipdate'])}",
    "correlation_matrix": f"WITH {LINEITEM_GAPS_SQL} {_corr_sql('gaps', LINEITEM_NUMERIC)}",
    "correlation_few_columns": f"""WITH p AS (SELECT p_size, CASE WHEN p_size > 3 THEN p_retailprice END AS price, 1.0::DOUBLE AS constant FROM part)
{_corr_sql("p", ["p_size", "price", "constant"])}""",
    "correlation_far_from_zero": f"""WITH f AS (
 SELECT a, 2 * a + 1 AS b, l_quantity, l_extendedprice
 FROM (SELECT CASE WHEN l_orderkey > 1000 THEN l_orderkey + 1.7e9::DOUBLE END AS a, l_quantity, l_extendedprice FROM lineitem))
{_corr_sql("f", ["a", "b", "l_quantity", "l_extendedprice"])}""",
    "histogram": f"WITH {LINEITEM_GAPS_SQL} {_hist_sql('gaps', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_suppkey'])}",
    "boxplot": f"WITH {LINEITEM_GAPS_SQL} {_box_sql('gaps', LINEITEM_NUMERIC)}",
    "sample_of_copies": "SELECT LEAST(50, COUNT(*)) AS rows, COUNT(DISTINCT event_type) AS contents FROM events",
    "sample_rows": """SELECT event_id, user_id, event_type, value, props FROM events
 ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 50""",
    "size_estimate": f"""SELECT bytes, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE)
 WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0::DOUBLE)
 WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0::DOUBLE)
 WHEN bytes < 1099511627776 THEN printf('%.1f GB', bytes / 1073741824.0::DOUBLE)
 ELSE printf('%.1f TB', bytes / 1099511627776.0::DOUBLE) END AS memory
 FROM (SELECT CAST(SUM(16 + {_DOCS_TEXT}) AS BIGINT) AS bytes FROM documents) t""",
    "target_candidates": f"""WITH {LINEITEM_GAPS_SQL}, d AS ({_distinct_sql("gaps", LINEITEM)})
SELECT "column" FROM d WHERE d >= 2 AND d <= 20 AND d::DOUBLE / n <= 0.9""",
    "bounded_cardinality": f"""WITH {LINEITEM_GAPS_SQL}, d AS ({_distinct_sql("gaps", LINEITEM)})
SELECT "column", CASE WHEN d <= 20 THEN d END AS distinct_values FROM d""",
    "problem_type": f"""WITH {LINEITEM_GAPS_SQL}, d AS ({_distinct_sql("gaps", [*LINEITEM_NUMERIC, "l_returnflag", "l_linestatus"])})
SELECT "column", CASE WHEN d = 2 THEN 'binary_classification' WHEN d <= 20 THEN 'multiclass_classification' ELSE 'regression' END AS problem_type FROM d""",
    "class_distribution": f"""WITH {ORDERS_GAPS_SQL} SELECT o_orderpriority AS value, COUNT(*) AS count FROM gaps
 WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority ORDER BY count DESC, value""",
    "regression_summary": f"""WITH {ORDERS_GAPS_SQL} SELECT round(AVG(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
 round(MIN(o_totalprice), 6) AS min, round(MAX(o_totalprice), 6) AS max, round(stddev_samp(o_totalprice), 6) AS std FROM gaps""",
    "profile": f"""WITH {ORDERS_GAPS_SQL}, num AS ({_numeric_sql("gaps", _PROFILE_NUMERIC)}), cat AS ({_categorical_sql("gaps", _PROFILE_TEXT)})
SELECT "column", 'numeric' AS dtype, missing_count, missing_pct, mean, median, mode AS mode_number, CAST(NULL AS VARCHAR) AS mode_text,
 min, max, std, CAST(NULL AS BIGINT) AS unique_count FROM num
UNION ALL
SELECT "column", 'categorical', missing_count, missing_pct, {_NULL}, {_NULL}, {_NULL}, mode, {_NULL}, {_NULL}, {_NULL}, unique_count FROM cat""",
}
