"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.tables import ORDERS_GAPS_SQL, orders_gaps, r, read
from tablewright.constants import BINARY, MULTICLASS, REGRESSION
from tablewright.operators.features import (
    add_date_parts,
    add_frequency_encoding,
    add_interactions,
    add_squares,
    add_target_encoding,
    correlated_drops,
    date_parse_rates,
)
from tablewright.operators.target import Target
from tablewright.plans.engineer import engineer_features


def _dated(spark, sf_dir):
    """Order dates as text: all good, 1 % and about 20 % unreadable, and in another spelling."""
    o = read(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 100 == 0, "n/a-x").otherwise(iso).alias("mostly"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a-x").otherwise(iso).alias("partly"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("slashed"),
        "o_orderpriority",
        "o_orderdate",
    )


def date_detect(spark, sf_dir):
    return date_parse_rates(_dated(spark, sf_dir)).select(
        "column", "non_null", "parsed", r(F.col("rate")).alias("rate"), "is_date"
    )


def date_parts(spark, sf_dir):
    out = add_date_parts(_dated(spark, sf_dir).select("o_orderkey", "mostly", "slashed", "o_orderdate"), ["mostly", "slashed", "o_orderdate"])
    return out


_SPELLINGS = ["M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm", "MMM d, yyyy", "d MMMM yyyy", "EEEE, MMMM d, yyyy", "yyyyMMdd", "M/d/yy", "yyyy.M.d hh:mm a", "dd-MMM-yyyy", "dd/MM/yyyy"]


def date_grammar(spark, sf_dir):
    """Parts of order dates in eleven spellings; the last one is read day first where the day is above 12."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % len(_SPELLINGS)
    text = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(_SPELLINGS)])
    text = F.when((k == len(_SPELLINGS) - 1) & (F.dayofmonth("o_orderdate") <= 12), F.date_format("o_orderdate", "M/d/yyyy")).otherwise(text)
    return add_date_parts(o.select("o_orderkey", text.alias("d")), ["d"])


def interactions(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    out = add_interactions(li, li.columns)
    made = [c for c in out.columns if "_x_" in c]
    # one row per line number keeps the result small; every row takes part
    return out.groupBy("l_linenumber").agg(*[r(F.avg(c), 4).alias(c) for c in made])


def polynomial(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = add_squares(p, ["p_size", "p_retailprice"])
    return out.select("p_partkey", "p_size_squared", r(F.col("p_retailprice_squared"), 4).alias("p_retailprice_squared"))


def frequency_encode(spark, sf_dir):
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    out = add_frequency_encoding(df, ["o_orderpriority", "o_orderstatus"])
    return out.select("o_orderkey", r(F.col("o_orderpriority_freq")).alias("o_orderpriority_freq"), r(F.col("o_orderstatus_freq")).alias("o_orderstatus_freq"))


def target_encode(spark, sf_dir):
    df = orders_gaps(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = add_target_encoding(df, ["o_orderpriority"], Target("o_totalprice", REGRESSION))
    return out.select("o_orderkey", r(F.col("o_orderpriority_target_enc")).alias("o_orderpriority_target_enc"))


def target_encode_binary(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(
        read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    out = add_target_encoding(df, ["lang", "source"], Target("quality", BINARY))
    return out.select("doc_id", r(F.col("lang_target_enc")).alias("lang_target_enc"), r(F.col("source_target_enc")).alias("source_target_enc"))


def drop_correlated(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * 2 + 1).alias("double_quantity"), (-F.col("l_discount")).alias("negative_discount")
    )
    return spark.createDataFrame(correlated_drops(li), "dropped string, kept string, correlation double")


def engineered(spark, sf_dir):
    """The whole chain over parts with a date.

    Squares and products with the year are dropped as correlated while the years
    lie close together; with part keys in the millions they spread over thousands
    of years, and a product with the year is a column of its own.
    """
    parts = read(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        F.nullif("p_brand", F.lit("Brand#7")).alias("p_brand"),
        "p_size",
        # not by a format, which goes through a timestamp
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 9).cast("int")).cast("string").alias("made"),
        "p_retailprice",
    )
    out, _ = engineer_features(parts, Target("p_retailprice", REGRESSION), keep=["p_partkey"])
    text = {"p_name", "p_brand"}
    return out.select("p_partkey", *[F.col(c) if c in text else r(F.col(c).cast("double")).alias(c) for c in out.columns if c != "p_partkey"])


def engineer_report(spark, sf_dir):
    """What feature engineering made of orders, step by step; drops are those of two columns that are one another's square or product."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    _, report = engineer_features(df, Target("o_orderstatus", MULTICLASS), keep=["o_orderkey"])
    return report.rows(spark).where("step NOT IN ('dropped', 'count')").select("step", "source", "made")


QUERIES = {
    "date_detect": date_detect,
    "date_parts": date_parts,
    "date_grammar": date_grammar,
    "interactions": interactions,
    "polynomial": polynomial,
    "frequency_encode": frequency_encode,
    "target_encode": target_encode,
    "target_encode_binary": target_encode_binary,
    "drop_correlated": drop_correlated,
    "engineer_report": engineer_report,
    "engineer_features": engineered,
}

_DATED_SQL = """dated AS (SELECT o_orderkey, CASE WHEN o_custkey % 100 = 0 THEN 'n/a-x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mostly,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a-x' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partly,
 strftime(o_orderdate, '%m/%d/%Y') AS slashed, o_orderpriority, o_orderdate FROM orders)"""


def _rate_sql(name: str, parsed: str) -> str:
    return f"""SELECT '{name}' AS "column", COUNT({name}) AS non_null, COUNT({parsed}) AS parsed,
 round(COUNT({parsed})::DOUBLE / COUNT({name}), 6) AS rate, COUNT({parsed})::DOUBLE / COUNT({name}) >= 0.9 AS is_date FROM dated"""


def _parts_sql(name: str, value: str) -> str:
    return f"year({value})::INTEGER AS {name}_year, month({value})::INTEGER AS {name}_month, (isodow({value}) - 1)::INTEGER AS {name}_weekday"


_PAIRS = [
    (a, b)
    for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    for b in ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"][i + 1 :]
]
_CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "double_quantity", "negative_discount"]

_MADE_OF = ["o_custkey", "o_totalprice", "o_orderdate_year", "o_orderdate_month", "o_orderdate_weekday"]
_MADE = [("date", "o_orderdate", f"o_orderdate_{x}") for x in ("year", "month", "weekday")]
_MADE += [("interaction", f"{a}, {b}", f"{a}_x_{b}") for i, a in enumerate(_MADE_OF) for b in _MADE_OF[i + 1 :]]
_MADE += [("square", a, f"{a}_squared") for a in _MADE_OF] + [("frequency", "o_orderpriority", "o_orderpriority_freq")]

SQL = {
    "engineer_report": "SELECT * FROM (VALUES "
    + ", ".join(str(row) for row in _MADE)
    + ", ('target_encoding_skipped', NULL, 'Skipped: a multiclass target has no mean to encode')) t(step, source, made) WHERE (SELECT COUNT(*) FROM orders) > 0",
    "date_grammar": """SELECT o_orderkey, year(o_orderdate)::INTEGER AS d_year, month(o_orderdate)::INTEGER AS d_month,
 (isodow(o_orderdate) - 1)::INTEGER AS d_weekday FROM orders""",
    "date_detect": f"WITH {_DATED_SQL} "
    + " UNION ALL ".join(
        [
            _rate_sql("mostly", "TRY_CAST(mostly AS DATE)"),
            _rate_sql("partly", "TRY_CAST(partly AS DATE)"),
            _rate_sql("slashed", "try_strptime(slashed, '%m/%d/%Y')"),
            _rate_sql("o_orderpriority", "TRY_CAST(o_orderpriority AS DATE)"),
            _rate_sql("o_orderdate", "o_orderdate"),
        ]
    ),
    "date_parts": f"""WITH {_DATED_SQL} SELECT o_orderkey, {_parts_sql("mostly", "TRY_CAST(mostly AS DATE)")},
 {_parts_sql("slashed", "try_strptime(slashed, '%m/%d/%Y')")}, {_parts_sql("o_orderdate", "o_orderdate")} FROM dated""",
    "interactions": "SELECT l_linenumber, "
    + ", ".join(f"round(AVG({a}::DOUBLE * {b}::DOUBLE), 4) AS {a}_x_{b}" for a, b in _PAIRS)
    + " FROM lineitem GROUP BY l_linenumber",
    "polynomial": """SELECT p_partkey, (p_size::DOUBLE * p_size) AS p_size_squared,
 round(p_retailprice * p_retailprice, 4) AS p_retailprice_squared FROM part""",
    "frequency_encode": f"""WITH {ORDERS_GAPS_SQL},
 a AS (SELECT o_orderpriority AS k, COUNT(*)::DOUBLE / (SELECT COUNT(o_orderpriority) FROM gaps) AS f FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1),
 b AS (SELECT o_orderstatus AS k, COUNT(*)::DOUBLE / (SELECT COUNT(o_orderstatus) FROM gaps) AS f FROM gaps WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(a.f, 6) AS o_orderpriority_freq, round(b.f, 6) AS o_orderstatus_freq
FROM gaps LEFT JOIN a ON a.k = o_orderpriority LEFT JOIN b ON b.k = o_orderstatus""",
    "target_encode": f"""WITH {ORDERS_GAPS_SQL}, a AS (SELECT o_orderpriority AS k, AVG(o_totalprice) AS m FROM gaps GROUP BY 1)
SELECT o_orderkey, round(m, 6) AS o_orderpriority_target_enc FROM gaps LEFT JOIN a ON k = o_orderpriority""",
    "target_encode_binary": """WITH d AS (SELECT d.doc_id, lang, source, CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 END AS y FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
 a AS (SELECT lang AS k, AVG(y) AS m FROM d GROUP BY 1), b AS (SELECT source AS k, AVG(y) AS m FROM d GROUP BY 1)
SELECT doc_id, round(a.m, 6) AS lang_target_enc, round(b.m, 6) AS source_target_enc FROM d LEFT JOIN a ON a.k = lang LEFT JOIN b ON b.k = source""",
    "drop_correlated": """WITH t AS (SELECT *, l_quantity * 2 + 1 AS double_quantity, -l_discount AS negative_discount FROM lineitem),
 c AS (SELECT 'double_quantity' AS dropped, 'l_quantity' AS kept, ABS(corr(l_quantity, double_quantity)) AS v FROM t
 UNION ALL SELECT 'negative_discount', 'l_discount', ABS(corr(l_discount, negative_discount)) FROM t
 UNION ALL SELECT 'l_extendedprice', 'l_quantity', ABS(corr(l_quantity, l_extendedprice)) FROM t)
SELECT dropped, kept, round(v, 4) AS correlation FROM c WHERE v > 0.95""",
    "engineer_features": """WITH p AS (SELECT p_partkey, p_name, NULLIF(p_brand, 'Brand#7') AS p_brand, p_size::DOUBLE AS p_size, p_retailprice,
  CAST(DATE '1995-01-01' + CAST(p_partkey * 9 AS INTEGER) AS DATE) AS made FROM part),
 d AS (SELECT *, year(made)::DOUBLE AS y, month(made)::DOUBLE AS m, (isodow(made) - 1)::DOUBLE AS w FROM p),
 a AS (SELECT p_name AS k, COUNT(*)::DOUBLE / (SELECT COUNT(p_name) FROM p) AS f, AVG(p_retailprice) AS e FROM p WHERE p_name IS NOT NULL GROUP BY 1),
 b AS (SELECT p_brand AS k, COUNT(*)::DOUBLE / (SELECT COUNT(p_brand) FROM p) AS f, AVG(p_retailprice) AS e FROM p WHERE p_brand IS NOT NULL GROUP BY 1)
SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 6) AS p_retailprice, y AS made_year, m AS made_month, w AS made_weekday,
 p_size * m AS p_size_x_made_month, p_size * w AS p_size_x_made_weekday, m * w AS made_month_x_made_weekday,
 round(a.f, 6) AS p_name_freq, round(a.e, 6) AS p_name_target_enc, round(b.f, 6) AS p_brand_freq, round(b.e, 6) AS p_brand_target_enc
FROM d LEFT JOIN a ON a.k = p_name LEFT JOIN b ON b.k = p_brand""",
}
