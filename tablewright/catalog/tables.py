"""Shared inputs. The given tables have no NULLs, so some values are turned into NULL on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if n in columns else F.col(n) for n in df.columns])


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


LINEITEM_GAPS_SQL = """
gaps AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         NULLIF(l_quantity, 17) AS l_quantity, l_extendedprice,
         NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.04) AS l_tax,
         NULLIF(l_returnflag, 'A') AS l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)
"""


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.nullif("l_quantity", F.lit(17.0)).alias("l_quantity"),
        "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.04)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"),
        "l_linestatus",
        "l_shipdate",
    )


ORDERS_GAPS_SQL = """
gaps AS (
  SELECT o_orderkey, NULLIF(o_custkey, 7) AS o_custkey, o_orderstatus,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS o_totalprice,
         o_orderdate, NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority
  FROM orders)
"""


def orders_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.nullif("o_custkey", F.lit(7)).alias("o_custkey"),
        "o_orderstatus",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )


# Rows in hash order of their key: the SQL form of the split hash.
def split_hash_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|42'), 1, 15) AS BIGINT)"
