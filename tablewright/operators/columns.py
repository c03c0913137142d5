"""Per-column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.constants import TOP_VALUES
from tablewright.functions.kinds import categorical_columns, numeric_columns
from tablewright.functions.values import half_even, without_nan
from tablewright.operators.frequencies import modes, numeric_frequencies, text_frequencies, top_values
from tablewright.operators.quantiles import Summary, numeric_summaries

_NUMERIC_ROW = (
    "column string, missing_count bigint, missing_pct double, mean double, median double, "
    "min double, max double, std double"
)


def numeric_stats(
    df: DataFrame, columns: Sequence[str] | None = None, summaries: dict[str, Summary] | None = None
) -> DataFrame:
    """Mean, median, mode, extremes and sample deviation of each numeric column."""
    names = list(columns if columns is not None else numeric_columns(df))
    spark = df.sparkSession
    summaries = summaries or numeric_summaries(df, names)
    rows = [
        (n, s.missing, _pct(s.missing, s.rows), s.mean, s.median, s.min, s.max, s.std)
        for n, s in ((n, summaries[n]) for n in names)
    ]
    stats = spark.createDataFrame(rows, _NUMERIC_ROW)
    if not names:
        return stats.withColumn("mode", F.lit(None).cast("double"))
    mode = modes(numeric_frequencies(df, names)).select("column", "mode")
    # one row per column on the right-hand side
    return stats.join(F.broadcast(mode), "column", "left")


def _pct(part: int, whole: int) -> float:
    return round(part / whole * 100, 2) if whole else 0.0


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """Missing values, mode and distinct count of each categorical column."""
    names = list(columns if columns is not None else categorical_columns(df))
    if frequencies is None:
        frequencies = text_frequencies(df, names)
    nulls = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(without_nan(df, n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
    ).select(
        "rows",
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing_count")) for i, n in enumerate(names)])
        ),
    )
    pct = F.coalesce(F.try_divide(F.col("missing_count").cast("double"), F.col("rows")) * 100, F.lit(0.0))
    return nulls.join(F.broadcast(modes(frequencies)), "column", "left").select(
        "column",
        "missing_count",
        half_even(pct, 2).alias("missing_pct"),
        "mode",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


def categorical_top_values(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_VALUES, frequencies: DataFrame | None = None
) -> DataFrame:
    """The most frequent values of each categorical column."""
    names = list(columns if columns is not None else categorical_columns(df))
    if frequencies is None:
        frequencies = text_frequencies(df, names)
    return top_values(frequencies, limit).select("column", "rank", "value", "count")
