"""Category encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.constants import ONE_HOT_MAX_CATEGORIES, UNSEEN_CATEGORY_CODE
from tablewright.functions.kinds import categorical_columns, column
from tablewright.functions.values import without_nan
from tablewright.operators.frequencies import modes, text_frequencies
from tablewright.operators.lookup import left_lookup
from tablewright.operators.overview import small_cardinalities
from tablewright.operators.ranking import running_totals


def cardinality_split(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, int], list[str]]:
    """Columns with at most ten distinct values (with their count), and the others."""
    counts = small_cardinalities(df, columns, ONE_HOT_MAX_CATEGORIES)
    low = {n: counts[n] for n in columns if counts[n] is not None}
    return low, [n for n in columns if n not in low]


def encoding_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which encoding each categorical column gets and how many columns result."""
    names = list(columns if columns is not None else categorical_columns(df))
    return encoding_rows(df, *cardinality_split(df, names))


def encoding_rows(df: DataFrame, low: dict[str, int], high: Sequence[str]) -> DataFrame:
    rows = [(n, "one_hot", k, k) for n, k in low.items()]
    schema = "column string, strategy string, categories_count bigint, resulting_columns bigint"
    out = df.sparkSession.createDataFrame(rows, schema)
    if not high:
        return out
    # group by (column, value) first: distinct values are counted in parallel
    many = modes(text_frequencies(df, list(high))).select(
        "column",
        F.lit("ordinal").alias("strategy"),
        F.col("unique_count").alias("categories_count"),
        F.lit(1).cast("bigint").alias("resulting_columns"),
    )
    return out.unionByName(many)


def one_hot(value: Column, name: str, categories: Sequence[str]) -> list[Column]:
    """One 0/1 column per category, all zeros for an unseen one."""
    return [F.when(value == F.lit(c), 1.0).otherwise(0.0).alias(f"{name}_{c}") for c in categories]


def ordinal_codes(df: DataFrame, name: str, rows_hint: int | None = None) -> DataFrame:
    """``(key, code, count)``: rank of each distinct value in sorted order, from 0."""
    table = (
        df.select(without_nan(df, name).alias("key"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = running_totals(table, [], ["key"], {"code": F.lit(1)}, rows_hint)
    return ranked.select("key", (F.col("code") - 1).cast("bigint").alias("code"), "count")


def apply_ordinal(df: DataFrame, name: str, codes: DataFrame, size_bytes: int, total_rows: int | None, out: str, share: int = 1) -> DataFrame:
    looked_up = left_lookup(df, name, codes, ["code"], size_bytes, "count", total_rows, share)
    return looked_up.withColumn(out, F.coalesce("code", F.lit(UNSEEN_CATEGORY_CODE)).cast("double")).drop("code")


def label_encode(df: DataFrame, name: str, labels: Sequence, out: str = "label") -> DataFrame:
    """Position of the class among the sorted labels; NULL for other values."""
    c = without_nan(df, name)
    code = None
    for i, v in enumerate(labels):
        code = F.when(c == F.lit(v), float(i)) if code is None else code.when(c == F.lit(v), float(i))
    return df.withColumn(out, code)
