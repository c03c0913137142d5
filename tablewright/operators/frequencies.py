"""Value-frequency tables.

``(column, value, count)`` for many columns from one scan per value type. The
count is combined on the map side, so a value that fills a third of the table
reaches the shuffle as one row per task, and the (column, value) key spreads
the rest. Values are grouped in their own type and rendered afterwards: text
is formatted once per distinct value, and large integer keys stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import column
from tablewright.functions.values import without_nan

TALLY = "count"


def _families(df: DataFrame, columns: Sequence[str]) -> list[tuple[T.DataType, list[str]]]:
    by: dict[T.DataType, list[str]] = {}
    for n in columns:
        dtype = df.schema[n].dataType
        if isinstance(dtype, T.IntegralType):
            dtype = T.LongType()
        elif isinstance(dtype, (T.FloatType, T.DecimalType)):
            dtype = T.DoubleType()
        by.setdefault(dtype, []).append(n)
    return list(by.items())


def _counted(df: DataFrame, dtype: T.DataType, names: Sequence[str]) -> DataFrame:
    return _counted_cells(df.select(*[without_nan(df, n).cast(dtype).alias(n) for n in names]), names)


def _counted_cells(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(names) == 1:
        long = cells.select(F.lit(names[0]).alias("column"), column(names[0]).alias("value"))
    else:
        long = cells.unpivot([], [column(n) for n in names], "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias(TALLY))


def _frequencies(df: DataFrame, columns: Sequence[str], render: Callable[[T.DataType, Column], Column]) -> DataFrame:
    parts = [
        _counted(df, dtype, names).withColumn("value", render(dtype, F.col("value")))
        for dtype, names in _families(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def _text(dtype: T.DataType, value: Column) -> Column:
    text = value.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def text_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every non-null value, rendered as text."""
    return _frequencies(df, columns, _text)


def numeric_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every non-null number, as double."""
    return _frequencies(df, columns, lambda _, value: value.cast("double"))


def value_counts(df: DataFrame, names: Sequence[str], codes: Sequence[Column]) -> DataFrame:
    """``(column, value, count)`` of small integer codes computed from each row."""
    cells = df.select(*[c.cast("int").alias(n) for n, c in zip(names, codes)])
    return _counted_cells(cells, names)


def modes(frequencies: DataFrame) -> DataFrame:
    """Per column the most frequent value, the smallest one on a tie, and the number of distinct values."""
    best = F.min(F.struct((-F.col(TALLY)).alias("neg"), F.col("value").alias("value")))
    return frequencies.groupBy("column").agg(
        best.getField("value").alias("mode"), F.count(F.lit(1)).alias("unique_count")
    )


def top_values(frequencies: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per column, ties by value.

    Spark pushes the rank limit below the shuffle, so each task sends at most
    ``limit`` rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.col(TALLY).desc(), F.col("value").asc())
    return frequencies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
