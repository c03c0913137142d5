"""Whole-table facts: shape, missing values, duplicates, size, target candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import (
    TARGET_MAX_DISTINCT,
    TARGET_MAX_UNIQUENESS,
    TARGET_MIN_DISTINCT,
)
from tablewright.functions.kinds import column, is_numeric, numeric_columns
from tablewright.functions.values import half_even, size_text_column, without_nan
from tablewright.operators.frequencies import modes, text_frequencies

# Relative error asked of the distinct-count sketch.
SKETCH_RSD = 0.05


def missing_values(df: DataFrame) -> DataFrame:
    """One row per column: missing count and percentage, from a single scan."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(without_nan(df, n).isNull()).alias(f"m{i}") for i, n in enumerate(df.columns)],
    )
    long = counts.select(
        "rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.col(f"m{i}").alias("missing_count"))
                    for i, n in enumerate(df.columns)
                ]
            )
        ),
    )
    pct = F.coalesce(F.try_divide(F.col("missing_count").cast("double"), F.col("rows")) * 100, F.lit(0.0))
    return long.select("position", "column", "missing_count", half_even(pct, 2).alias("missing_pct"))


def missing_only(missing: DataFrame) -> DataFrame:
    return missing.where(F.col("missing_count") > 0)


def row_digest(df: DataFrame) -> list:
    """Two independent 64-bit hashes of a row; equal rows agree, NULLs and NaNs included.

    Spark's hash skips NULLs, so the mask of NULL positions is hashed as well, and
    nested values are hashed as JSON text that keeps them.
    """
    values = []
    for f in df.schema.fields:
        c = column(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # -0.0 equals 0.0, and NaN counts as missing
            c = F.when(~F.isnan(c), c + F.lit(0.0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        values.append(c)
    mask = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    return [
        F.xxhash64(mask, *values).alias("h1"),
        F.xxhash64(F.lit("second digest"), *reversed(values), mask).alias("h2"),
    ]


def duplicate_count(df: DataFrame, whole_rows: bool = False) -> DataFrame:
    """Rows that repeat an earlier row over all columns.

    By default 16 bytes per row are shuffled: a 128-bit digest stands for the
    row (a false match among 10^12 rows has odds near 10^-15). With
    ``whole_rows`` complete rows are compared instead.
    """
    if whole_rows:
        grouped = df.groupBy(*[without_nan(df, n).alias(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    else:
        grouped = df.select(*row_digest(df)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns, kinds and the overall share of missing cells."""
    n_cols, n_num = len(df.columns), len(numeric_columns(df))
    nulls = [F.when(without_nan(df, n).isNull(), 1).otherwise(0) for n in df.columns]
    per_row = nulls[0]
    for e in nulls[1:]:
        per_row = per_row + e
    agg = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(per_row), F.lit(0)).alias("nulls"))
    pct = F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("rows") * n_cols) * 100, F.lit(0.0))
    return agg.select(
        "rows",
        F.lit(n_cols).alias("columns"),
        F.lit(n_num).alias("numeric_columns"),
        F.lit(n_cols - n_num).alias("categorical_columns"),
        half_even(pct, 2).alias("missing_values_pct"),
    )


def size_estimate(df: DataFrame) -> DataFrame:
    """Estimated bytes in memory: text lengths plus fixed widths, with a readable text."""
    fixed, lengths = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            fixed += 1
        elif is_numeric(f.dataType) or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fixed += 8
        else:
            lengths.append(F.coalesce(F.octet_length(column(f.name).cast("string")), F.lit(0)).cast("bigint"))
    per_row = F.lit(fixed).cast("bigint")
    for e in lengths:
        per_row = per_row + e
    total = df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("bytes"))
    return total.select("bytes", size_text_column(F.col("bytes")).alias("memory"))


def small_cardinalities(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts up to ``limit``; None means "more than ``limit``".

    A column with at most ``limit`` distinct values fills at most ``limit``
    registers of a distinct-count sketch, so an estimate clearly above the
    limit proves there are more. Only the columns left are counted exactly,
    and those have few distinct values: nothing large is shuffled.
    """
    if not columns:
        return {}
    # Exact counting is cheap up to a few times the limit, so the margin is wide.
    above = 4 * limit + 50
    hashed = df.select(
        *[F.when(without_nan(df, n).isNotNull(), F.xxhash64(column(n))).alias(f"h{i}") for i, n in enumerate(columns)]
    )
    ids = {f"h{i}": n for i, n in enumerate(columns)}
    long = (
        hashed.unpivot([], list(ids), "column", "value")
        if len(ids) > 1
        else hashed.select(F.lit("h0").alias("column"), F.col("h0").alias("value"))
    )
    estimates = {
        ids[r["column"]]: r["d"]
        for r in long.groupBy("column").agg(F.approx_count_distinct("value", SKETCH_RSD).alias("d")).collect()
    }
    few = [n for n in columns if estimates.get(n, 0) <= above]
    counts: dict[str, int | None] = dict.fromkeys(columns)
    if few:
        exact = {r["column"]: r["unique_count"] for r in modes(text_frequencies(df, few)).collect()}
        for n in few:
            distinct = exact.get(n, 0)
            counts[n] = distinct if distinct <= limit else None
    return counts


def countable_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared; maps and the like cannot be targets."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]


def target_candidates(df: DataFrame) -> list[str]:
    """Columns that look like a label: few distinct values, not nearly unique."""
    names = countable_columns(df)
    counts = small_cardinalities(df, names, TARGET_MAX_DISTINCT)
    kept = [n for n in names if counts[n] is not None and counts[n] >= TARGET_MIN_DISTINCT]
    # With at most 20 distinct values the ratio can only exceed 0.9 in a table of
    # at most 22 rows, so a bounded look at the table settles it.
    most = int(TARGET_MAX_DISTINCT / TARGET_MAX_UNIQUENESS) + 1
    rows = df.select(F.lit(1)).limit(most + 1).count()
    if rows > most:
        return kept
    return [n for n in kept if counts[n] / rows <= TARGET_MAX_UNIQUENESS]


def dataset_summary(df: DataFrame) -> DataFrame:
    """What an upload reports: rows, columns, memory, duplicates and candidate targets."""
    spark = df.sparkSession
    row = shape(df).first()
    size = size_estimate(df).first()
    dup = duplicate_count(df).first()
    return spark.createDataFrame(
        [(row["rows"], row["columns"], size["memory"], dup["duplicate_rows"], target_candidates(df))],
        "rows bigint, columns int, memory string, duplicate_rows bigint, target_candidates array<string>",
    )
