"""Histograms and box plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.constants import HISTOGRAM_BINS, WHISKER_IQR_FACTOR
from tablewright.functions.kinds import numeric_columns
from tablewright.functions.values import as_double
from tablewright.operators.frequencies import value_counts
from tablewright.operators.quantiles import Summary, numeric_summaries


def histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = HISTOGRAM_BINS,
    summaries: dict[str, Summary] | None = None,
) -> DataFrame:
    """Equal-width bins per numeric column; the last bin includes its right edge.

    Columns without two distinct values are left out. Each row's bin numbers are
    computed next to the scan and only (column, bin) counts are shuffled.
    """
    names = list(columns if columns is not None else numeric_columns(df))
    spark = df.sparkSession
    summaries = summaries or numeric_summaries(df, names, probs=())
    spread = {n: (s.min, s.max) for n, s in summaries.items() if n in names and s.count and s.min < s.max}
    schema = "column string, bin int, lo double, hi double, count bigint"
    if not spread:
        return spark.createDataFrame([], schema)

    names = list(spread)
    bins_of, edges = [], {}
    for n, (lo, hi) in spread.items():
        width = (hi - lo) / bins
        edges[n] = [lo + i * width for i in range(bins)] + [hi]
        x = as_double(df, n)
        # Compared with the edges themselves: dividing can land next to the right bin.
        number = F.when(x < F.lit(edges[n][1]), 0)
        for b in range(1, bins - 1):
            number = number.when(x < F.lit(edges[n][b + 1]), b)
        bins_of.append(number.when(x.isNotNull(), bins - 1))
    counted = value_counts(df, names, bins_of)
    # columns times bins rows, also for bins that stay empty
    frame = spark.createDataFrame(
        [
            (n, b, round(edges[n][b], 4), round(edges[n][b + 1], 4))
            for n in names
            for b in range(bins)
        ],
        "column string, value int, lo double, hi double",
    )
    return frame.join(F.broadcast(counted), ["column", "value"], "left").select(
        "column",
        (F.col("value") + 1).alias("bin"),
        "lo",
        "hi",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def boxplots(
    df: DataFrame, columns: Sequence[str] | None = None, summaries: dict[str, Summary] | None = None
) -> DataFrame:
    """Quartiles, extremes and whiskers; a column without values is left out."""
    names = list(columns if columns is not None else numeric_columns(df))
    summaries = summaries or numeric_summaries(df, names, probs=(0.25, 0.5, 0.75))
    rows = []
    for n in names:
        s = summaries[n]
        if not s.count:
            continue
        q1, q2, q3 = (s.quantiles[p] for p in (0.25, 0.5, 0.75))
        reach = WHISKER_IQR_FACTOR * (q3 - q1)
        rows.append((n, s.min, q1, q2, q3, s.max, max(s.min, q1 - reach), min(s.max, q3 + reach)))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, min double, q1 double, median double, q3 double, max double, "
        "lower_whisker double, upper_whisker double",
    )
