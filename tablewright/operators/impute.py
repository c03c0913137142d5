"""Missing-value plan, imputation, standardisation and outlier clipping."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.constants import OUTLIER_CLIP_STD
from tablewright.functions.kinds import categorical_columns, numeric_columns
from tablewright.functions.values import as_double, as_text, without_nan
from tablewright.operators.frequencies import modes, text_frequencies, value_counts
from tablewright.operators.quantiles import Summary, numeric_summaries


def missing_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of rows, and missing values per column."""
    r = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(without_nan(df, n).isNull()).alias(f"m{i}") for i, n in enumerate(columns)],
    ).first()
    return r["rows"], {n: r[f"m{i}"] for i, n in enumerate(columns)}


def missing_value_plan(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns with missing values and what fills them: median for numbers, mode for the rest.

    Computed on all rows of ``df``; the fitted fill values of a model come from
    its training rows.
    """
    numeric = numeric_columns(df, exclude)
    categorical = categorical_columns(df, exclude)
    _, missing = missing_counts(df, numeric + categorical)
    num = [n for n in numeric if missing[n]]
    cat = [n for n in categorical if missing[n]]
    medians = numeric_summaries(df, num)
    mode_of = category_modes(df, cat)
    rows = [(n, "median", _plain(medians[n].median), missing[n]) for n in num]
    rows += [(n, "mode", mode_of.get(n) or "", missing[n]) for n in cat]
    return df.sparkSession.createDataFrame(
        rows, "column string, strategy string, fill_value string, missing_count bigint"
    )


def _plain(value: float | None) -> str | None:
    return None if value is None else repr(float(value))


def category_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest one on a tie: one row per column."""
    if not columns:
        return {}
    return {r["column"]: r["mode"] for r in modes(text_frequencies(df, columns)).collect()}


def filled(value: Column, fill) -> Column:
    return F.coalesce(value, fill if isinstance(fill, Column) else F.lit(fill))


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Replace missing values by fitted constants; other columns pass through."""
    numeric = set(numeric_columns(df))
    out = []
    for n in df.columns:
        if n not in fills or fills[n] is None:
            out.append(without_nan(df, n).alias(n))
        elif n in numeric:
            out.append(filled(as_double(df, n), float(fills[n])).alias(n))
        else:
            out.append(filled(as_text(df, n), fills[n]).alias(n))
    return df.select(*out)


def scaler_of(summary: Summary) -> tuple[float, float]:
    """Mean and population deviation after median imputation, without another scan.

    ``m`` missing values join the ``n`` present ones at the median; a constant
    column gets scale 1.
    """
    n, m, fill = summary.count, summary.missing, summary.median
    total = n + m
    mean = (n * summary.mean + m * fill) / total
    m2 = summary.m2 + n * m / total * (summary.mean - fill) ** 2
    std = math.sqrt(m2 / total)
    return mean, (std if std > 0 else 1.0)


def scaled(value: Column, mean: float, scale: float) -> Column:
    return (value - F.lit(mean)) / F.lit(scale)


def clipped(z: Column, bound: float = OUTLIER_CLIP_STD) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), z))


def clip_counts(df: DataFrame, z: Mapping[str, Column], bound: float = OUTLIER_CLIP_STD) -> DataFrame:
    """Values beyond the bound per column; columns without any are left out."""
    if not z:
        return df.sparkSession.createDataFrame([], "column string, clipped_count bigint")
    flags = [F.when(F.abs(e) > F.lit(bound), 1) for e in z.values()]
    return value_counts(df, list(z), flags).select("column", F.col("count").alias("clipped_count"))
