"""The full profile of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import categorical_columns, numeric_columns
from tablewright.operators.columns import categorical_stats, categorical_top_values, numeric_stats
from tablewright.operators.correlation import correlation_matrix
from tablewright.operators.distribution import boxplots, histograms
from tablewright.operators.frequencies import text_frequencies
from tablewright.operators.overview import duplicate_count, missing_values, shape
from tablewright.operators.quantiles import numeric_summaries
from tablewright.operators.sampling import sample_rows


@dataclass(frozen=True)
class Profile:
    shape: DataFrame
    duplicates: DataFrame
    missing: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    top_values: DataFrame
    correlation: DataFrame
    histograms: DataFrame
    boxplots: DataFrame
    sample: DataFrame


def profile(df: DataFrame, key: Sequence[str] | None = None) -> Profile:
    """Everything the explore step shows.

    Moments and quartiles are computed once and shared by the numeric
    statistics, histograms and box plots; the parts left lazy run when used.
    """
    numeric = numeric_columns(df)
    categorical = categorical_columns(df)
    summaries = numeric_summaries(df, numeric, (0.25, 0.5, 0.75))
    frequencies = text_frequencies(df, categorical) if categorical else None
    empty_cat = "column string, missing_count bigint, missing_pct double, mode string, unique_count bigint"
    empty_top = "column string, rank int, value string, count bigint"
    spark = df.sparkSession
    return Profile(
        shape=shape(df),
        duplicates=duplicate_count(df),
        missing=missing_values(df),
        numeric=numeric_stats(df, numeric, summaries),
        categorical=categorical_stats(df, categorical, frequencies)
        if categorical
        else spark.createDataFrame([], empty_cat),
        top_values=categorical_top_values(df, categorical, frequencies=frequencies)
        if categorical
        else spark.createDataFrame([], empty_top),
        correlation=correlation_matrix(df, numeric),
        histograms=histograms(df, numeric, summaries=summaries),
        boxplots=boxplots(df, numeric, summaries),
        sample=sample_rows(df, key),
    )


def column_profile(p: Profile) -> DataFrame:
    """Numeric and categorical statistics as one row per column."""
    numeric = p.numeric.select(
        "column",
        F.lit("numeric").alias("dtype"),
        "missing_count",
        "missing_pct",
        "mean",
        "median",
        F.col("mode").alias("mode_number"),
        F.lit(None).cast("string").alias("mode_text"),
        "min",
        "max",
        "std",
        F.lit(None).cast("bigint").alias("unique_count"),
    )
    none = F.lit(None).cast("double")
    categorical = p.categorical.select(
        "column",
        F.lit("categorical").alias("dtype"),
        "missing_count",
        "missing_pct",
        none.alias("mean"),
        none.alias("median"),
        none.alias("mode_number"),
        F.col("mode").alias("mode_text"),
        none.alias("min"),
        none.alias("max"),
        none.alias("std"),
        "unique_count",
    )
    return numeric.unionByName(categorical)
