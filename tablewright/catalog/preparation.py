"""Pre-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import LINEITEM_GAPS_SQL, ORDERS_GAPS_SQL, lineitem_gaps, orders_gaps, r, read, split_hash_sql
from tablewright.constants import MULTICLASS, REGRESSION
from tablewright.functions.values import as_double, as_text, coerce_payload, payload_number
from tablewright.operators.encode import apply_ordinal, encoding_summary, label_encode, one_hot, ordinal_codes
from tablewright.operators.impute import (
    category_modes,
    clip_counts,
    filled,
    impute,
    missing_value_plan,
    scaled,
    scaler_of,
)
from tablewright.operators.lookup import mapping_bytes
from tablewright.operators.quantiles import numeric_summaries
from tablewright.operators.split import fit_split
from tablewright.operators.target import Target, class_labels
from tablewright.plans.preprocess import preprocess


def missing_plan(spark, sf_dir):
    return missing_value_plan(orders_gaps(spark, sf_dir)).select(
        "column",
        "strategy",
        "missing_count",
        F.when(F.col("strategy") == "median", r(F.col("fill_value").try_cast("double"))).alias("fill_number"),
        F.when(F.col("strategy") == "mode", F.col("fill_value")).alias("fill_text"),
    )


def impute_median(spark, sf_dir):
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice")
    s = numeric_summaries(df, ["o_custkey", "o_totalprice"])
    out = impute(df, {n: s[n].median for n in s})
    return out.select("o_orderkey", *[r(F.col(n)).alias(n) for n in s])


def impute_mode(spark, sf_dir):
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority")
    return impute(df, category_modes(df, ["o_orderpriority"]))


def standard_scale(spark, sf_dir):
    df = orders_gaps(spark, sf_dir)
    s = numeric_summaries(df, ["o_custkey", "o_totalprice"])
    z = {n: scaled(filled(as_double(df, n), s[n].median), *scaler_of(s[n])) for n in s}
    return df.select("o_orderkey", *[r(c).alias(n) for n, c in z.items()])


def outlier_clips(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("n_chars")
    s = numeric_summaries(df, ["n_chars"])
    return clip_counts(df, {n: scaled(as_double(df, n), *scaler_of(s[n])) for n in s})


def one_hot_columns(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    names = [v for v in class_labels(df, "c_mktsegment")]
    return df.select("c_custkey", *one_hot(as_text(df, "c_mktsegment"), "c_mktsegment", names))


def ordinal_encode(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    sizes = mapping_bytes(df, ["p_name", "p_brand"])
    out = df
    for n in ("p_name", "p_brand"):
        out = apply_ordinal(out, n, ordinal_codes(df, n, rows_hint=sizes[n]), sizes[n], None, f"{n}_code")
    return out.select("p_partkey", "p_name_code", "p_brand_code")


def ordinal_encode_ranged(spark, sf_dir):
    """Codes through range partitions and the hot/cold join, as used for very many distinct values."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    codes = ordinal_codes(df, "c_name", rows_hint=None)
    out = apply_ordinal(df, "c_name", codes, 1 << 60, df.count(), "c_name_code")
    return out.select("c_custkey", "c_name_code")


def encodings(spark, sf_dir):
    return encoding_summary(read(spark, sf_dir, "part"))


def labels(spark, sf_dir):
    df = orders_gaps(spark, sf_dir)
    out = label_encode(df, "o_orderpriority", class_labels(df, "o_orderpriority"))
    return out.select("o_orderkey", "label")


def stratified_split(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    split = fit_split(df, Target("o_orderstatus", MULTICLASS), ["o_orderkey"])
    return split.mark(df).select("o_orderkey", "o_orderstatus", "is_test")


def random_split(spark, sf_dir):
    df = orders_gaps(spark, sf_dir)
    split = fit_split(df, Target("o_totalprice", REGRESSION), ["o_orderkey"])
    return split.mark(df).select("o_orderkey", "is_test")


def split_sizes(spark, sf_dir):
    df = read(spark, sf_dir, "labels")
    split = fit_split(df, Target("toxic", "binary_classification"), ["doc_id"])
    return (
        split.mark(df)
        .groupBy("toxic", "is_test")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("key_sum"))
        .withColumn("stratified", F.lit(split.stratified))
    )


def split_without_key(spark, sf_dir):
    """Sizes of both sides where rows have copies: only the flags and the line number of lineitem, no key."""
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    split = fit_split(df, Target("l_returnflag", MULTICLASS))
    marked = split.mark(df).groupBy("l_returnflag", "is_test").agg(F.count(F.lit(1)).alias("n"))
    sides = split.train(df).groupBy("l_returnflag").count().withColumn("is_test", F.lit(False)).unionByName(split.test(df).groupBy("l_returnflag").count().withColumn("is_test", F.lit(True)))
    return marked.join(sides, ["l_returnflag", "is_test"], "full").select("l_returnflag", "is_test", "n", F.col("count").alias("n_of_side"))


def feature_matrix(spark, sf_dir):
    """Split, imputation, scaling, clipping, one-hot and ordinal codes in one pass over the rows."""
    df = orders_gaps(spark, sf_dir).drop("o_orderdate").join(
        read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment", "c_name"),
        "o_custkey",
        "left",
    )
    p = preprocess(df, Target("o_orderstatus", MULTICLASS), ["o_orderkey"], exclude=["o_orderkey", "o_custkey", "c_nationkey"])
    marked = p.split.mark(df)
    out = p.preprocessor.feature_frame(marked, clip=True)
    names = [n.replace("-", "_").replace(" ", "_") for n in p.preprocessor.feature_names]
    return out.select(
        "o_orderkey",
        "is_test",
        *[r(F.col(f"_f{i}")).alias(n.lower()) for i, n in enumerate(names) if n.startswith(("o_totalprice", "c_"))],
    )


def preprocessing_report(spark, sf_dir):
    df = lineitem_gaps(spark, sf_dir).drop("l_shipdate")
    rep = preprocess(df, Target("l_linestatus", "binary_classification")).report
    rows = [
        ("feature_count_before", float(rep.feature_count_before)),
        ("feature_count_after", float(rep.feature_count_after)),
        ("columns_with_gaps", float(rep.missing_values.count())),
        ("scaled_columns", float(len(rep.scaling_columns))),
        ("dropped_rows", float(rep.dropped_rows)),
        ("rows", float(rep.train_rows + rep.test_rows)),
    ]
    return spark.createDataFrame(rows, "item string, value double")


def preprocessing_report_rows(spark, sf_dir):
    """The whole report of events: sizes, scaling, encodings, values beyond the outlier limit and their total."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.nullif("value", F.lit(0.0)).alias("value"))
    return preprocess(df, Target("event_type", MULTICLASS), ["event_id"], exclude=["event_id"]).report.rows(spark)


def payload(spark, sf_dir):
    """Form-field text to numbers: padded numbers, plain text and empty fields."""
    df = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("  "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("padded"),
        F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("status"),
        "o_orderpriority",
    )
    return df.select(
        "o_orderkey",
        payload_number(F.col("padded")).alias("padded_number"),
        payload_number(F.col("status")).alias("status_number"),
        F.when(payload_number(F.col("o_orderpriority")).isNull(), F.col("o_orderpriority")).alias("kept_text"),
    )


def typed_payload(spark, sf_dir):
    """A text-only frame converted to the types a model was fitted on."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("o_custkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("N/A")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return coerce_payload(text, orders.schema)


QUERIES = {
    "missing_plan": missing_plan,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "standard_scale": standard_scale,
    "outlier_clip": outlier_clips,
    "one_hot": one_hot_columns,
    "ordinal_encode": ordinal_encode,
    "ordinal_encode_ranged": ordinal_encode_ranged,
    "encoding_summary": encodings,
    "label_encode": labels,
    "stratified_split": stratified_split,
    "random_split": random_split,
    "split_sizes": split_sizes,
    "split_without_key": split_without_key,
    "feature_matrix": feature_matrix,
    "preprocessing_report": preprocessing_report,
    "preprocessing_report_rows": preprocessing_report_rows,
    "payload_coerce": payload,
    "payload_typed": typed_payload,
}


def _quota_sql(table: str, key: str, label: str) -> str:
    """Class-proportional split: test rows per class by largest remainder of the training share."""
    return f"""
counts AS (SELECT {label} AS cls, COUNT(*) AS n FROM {table} WHERE {label} IS NOT NULL GROUP BY {label}),
total AS (SELECT SUM(n) AS n, SUM(n) - CEIL(CAST(0.2 AS DOUBLE) * SUM(n)) AS n_train FROM counts),
shares AS (SELECT cls, counts.n AS n, FLOOR(counts.n * n_train / total.n) AS base,
   counts.n * n_train / total.n - FLOOR(counts.n * n_train / total.n) AS frac, n_train FROM counts, total),
quota AS (SELECT cls, n - (base + CASE WHEN row_number() OVER (ORDER BY frac DESC, cls) <= n_train - SUM(base) OVER () THEN 1 ELSE 0 END) AS n_test FROM shares),
marked AS (SELECT t.*, row_number() OVER (PARTITION BY {label} ORDER BY {split_hash_sql(key)}) <= q.n_test AS is_test
   FROM {table} t JOIN quota q ON t.{label} = q.cls)"""


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_MODE = "(SELECT o_orderpriority FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)"

SQL = {
    "missing_plan": f"""WITH {ORDERS_GAPS_SQL}
SELECT 'o_custkey' AS "column", 'median' AS strategy, COUNT(*) - COUNT(o_custkey) AS missing_count, round(quantile_cont(o_custkey::DOUBLE, 0.5), 6) AS fill_number, CAST(NULL AS VARCHAR) AS fill_text FROM gaps HAVING COUNT(*) > COUNT(o_custkey)
UNION ALL SELECT 'o_totalprice', 'median', COUNT(*) - COUNT(o_totalprice), round(quantile_cont(o_totalprice, 0.5), 6), NULL FROM gaps HAVING COUNT(*) > COUNT(o_totalprice)
UNION ALL SELECT 'o_orderpriority', 'mode', COUNT(*) - COUNT(o_orderpriority), NULL, {_MODE} FROM gaps HAVING COUNT(*) > COUNT(o_orderpriority)""",
    "impute_median": f"""WITH {ORDERS_GAPS_SQL} SELECT o_orderkey,
 round(COALESCE(o_custkey::DOUBLE, (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM gaps)), 6) AS o_custkey,
 round(COALESCE(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)), 6) AS o_totalprice FROM gaps""",
    "impute_mode": f"WITH {ORDERS_GAPS_SQL} SELECT o_orderkey, COALESCE(o_orderpriority, {_MODE}) AS o_orderpriority FROM gaps",
    "standard_scale": f"""WITH {ORDERS_GAPS_SQL}, full_rows AS (SELECT o_orderkey,
 COALESCE(o_custkey::DOUBLE, (SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM gaps)) AS a,
 COALESCE(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)) AS b FROM gaps)
SELECT o_orderkey, round((a - (SELECT AVG(a) FROM full_rows)) / (SELECT stddev_pop(a) FROM full_rows), 6) AS o_custkey,
 round((b - (SELECT AVG(b) FROM full_rows)) / (SELECT stddev_pop(b) FROM full_rows), 6) AS o_totalprice FROM full_rows""",
    "outlier_clip": """SELECT 'n_chars' AS "column", COUNT(*) AS clipped_count FROM documents
 WHERE ABS(n_chars - (SELECT AVG(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents) > 3 HAVING COUNT(*) > 0""",
    "one_hot": "SELECT c_custkey, "
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0 END AS \"c_mktsegment_{s}\"" for s in _SEGMENTS)
    + " FROM customer",
    "ordinal_encode": """SELECT p_partkey, (dense_rank() OVER (ORDER BY p_name) - 1)::DOUBLE AS p_name_code,
 (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand_code FROM part""",
    "ordinal_encode_ranged": "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name_code FROM customer",
    "encoding_summary": """SELECT "column", CASE WHEN d <= 10 THEN 'one_hot' ELSE 'ordinal' END AS strategy, d AS categories_count,
 CASE WHEN d <= 10 THEN d ELSE 1 END AS resulting_columns FROM (
 SELECT 'p_name' AS "column", COUNT(DISTINCT p_name) AS d FROM part
 UNION ALL SELECT 'p_brand', COUNT(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', COUNT(DISTINCT p_type) FROM part) t""",
    "label_encode": f"""WITH {ORDERS_GAPS_SQL} SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT NULL THEN
 (SELECT COUNT(DISTINCT g.o_orderpriority) FROM gaps g WHERE g.o_orderpriority < gaps.o_orderpriority)::DOUBLE END AS label FROM gaps""",
    "stratified_split": f"WITH {_quota_sql('orders', 'o_orderkey', 'o_orderstatus').strip()} SELECT o_orderkey, o_orderstatus, is_test FROM marked",
    "random_split": f"""WITH {ORDERS_GAPS_SQL}, known AS (SELECT * FROM gaps WHERE o_totalprice IS NOT NULL)
SELECT o_orderkey, row_number() OVER (ORDER BY {split_hash_sql("o_orderkey")}) <= (SELECT CEIL(CAST(0.2 AS DOUBLE) * COUNT(*)) FROM known) AS is_test FROM known""",
    "split_sizes": f"""WITH {_quota_sql("labels", "doc_id", "toxic").strip()}
SELECT toxic, is_test, COUNT(*) AS n, CAST(SUM(doc_id) AS BIGINT) AS key_sum, TRUE AS stratified FROM marked GROUP BY toxic, is_test""",
    "split_without_key": f"""WITH {_quota_sql("lineitem", "l_orderkey", "l_returnflag").strip()}
SELECT cls AS l_returnflag, t AS is_test, CAST(CASE WHEN t THEN n_test ELSE n - n_test END AS BIGINT) AS n, CAST(CASE WHEN t THEN n_test ELSE n - n_test END AS BIGINT) AS n_of_side
FROM quota JOIN counts USING (cls), (SELECT unnest([TRUE, FALSE]) AS t)""",
    "feature_matrix": f"""WITH {ORDERS_GAPS_SQL}, {_quota_sql("gaps", "o_orderkey", "o_orderstatus").strip()},
joined AS (SELECT m.*, c_mktsegment, c_name FROM marked m LEFT JOIN customer c ON m.o_custkey = c.c_custkey),
train AS (SELECT * FROM joined WHERE NOT is_test),
price AS (SELECT quantile_cont(o_totalprice, 0.5) AS fill FROM train),
scale AS (SELECT AVG(COALESCE(o_totalprice, fill)) AS mu, stddev_pop(COALESCE(o_totalprice, fill)) AS sd FROM train, price),
seg AS (SELECT c_mktsegment AS v FROM train WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
nam AS (SELECT c_name AS v FROM train WHERE c_name IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
codes AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code FROM (SELECT DISTINCT c_name FROM train WHERE c_name IS NOT NULL) d)
SELECT o_orderkey, is_test,
 round(GREATEST(-3, LEAST(3, (COALESCE(o_totalprice, fill) - mu) / sd)), 6) AS o_totalprice,
 {", ".join(f"CASE WHEN COALESCE(c_mktsegment, seg.v) = '{s}' THEN 1.0::DOUBLE ELSE 0.0 END AS c_mktsegment_{s.lower()}" for s in _SEGMENTS)},
 COALESCE(code, -1)::DOUBLE AS c_name
FROM joined CROSS JOIN price CROSS JOIN scale CROSS JOIN seg CROSS JOIN nam LEFT JOIN codes ON codes.c_name = COALESCE(joined.c_name, nam.v)""",
    "preprocessing_report": f"""WITH {LINEITEM_GAPS_SQL}
SELECT 'feature_count_before' AS item, 9.0::DOUBLE AS value
UNION ALL SELECT 'feature_count_after', 8.0 + COUNT(DISTINCT l_returnflag) FROM gaps
UNION ALL SELECT 'columns_with_gaps', (COUNT(*) > COUNT(l_quantity))::INT + (COUNT(*) > COUNT(l_discount))::INT + (COUNT(*) > COUNT(l_tax))::INT + (COUNT(*) > COUNT(l_returnflag))::INT FROM gaps
UNION ALL SELECT 'scaled_columns', 8.0
UNION ALL SELECT 'dropped_rows', COUNT(*) - COUNT(l_linestatus) FROM gaps
UNION ALL SELECT 'rows', COUNT(*) FROM gaps""",
    "preprocessing_report_rows": f"""WITH gaps AS (SELECT event_id, user_id, event_type, NULLIF(value, 0.0) AS value FROM events), {_quota_sql("gaps", "event_id", "event_type").strip()},
train AS (SELECT * FROM marked WHERE NOT is_test),
fill AS (SELECT quantile_cont(value, 0.5) AS v, quantile_cont(user_id::DOUBLE, 0.5) AS u FROM train),
stat AS (SELECT AVG(COALESCE(value, v)) AS mv, stddev_pop(COALESCE(value, v)) AS sv, AVG(COALESCE(user_id, u)) AS mu, stddev_pop(COALESCE(user_id, u)) AS su FROM train, fill),
clips AS (SELECT COUNT(*) FILTER (WHERE ABS(COALESCE(value, v) - mv) / sv > 3) AS cv, COUNT(*) FILTER (WHERE ABS(COALESCE(user_id, u) - mu) / su > 3) AS cu FROM marked, fill, stat),
gone AS (SELECT COUNT(*) - COUNT(value) AS g, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_test) AS t FROM marked)
SELECT 'size' AS section, CAST(NULL AS VARCHAR) AS "column", x.k AS detail, CAST(x.v AS BIGINT) AS n FROM (SELECT unnest([
 struct_pack(k := 'feature_count_before', v := 2), struct_pack(k := 'feature_count_after', v := 2), struct_pack(k := 'train_rows', v := n - t),
 struct_pack(k := 'test_rows', v := t), struct_pack(k := 'dropped_rows', v := 0), struct_pack(k := 'total_clipped', v := cv + cu)]) AS x FROM gone, clips)
UNION ALL SELECT 'scaling', unnest(['user_id', 'value']), 'StandardScaler', NULL
UNION ALL SELECT 'missing', 'value', 'median', g FROM gone WHERE g > 0
UNION ALL SELECT 'outliers', 'value', 'Clip standardized values beyond +/-3.0 std', cv FROM clips WHERE cv > 0
UNION ALL SELECT 'outliers', 'user_id', 'Clip standardized values beyond +/-3.0 std', cu FROM clips WHERE cu > 0""",
    "payload_coerce": """SELECT o_orderkey, o_custkey::DOUBLE AS padded_number, CAST(NULL AS DOUBLE) AS status_number, o_orderpriority AS kept_text FROM orders""",
    "payload_typed": """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS o_custkey,
 NULLIF(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders""",
}
