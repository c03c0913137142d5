"""Column kinds, projections and column checks. All of it reads the schema only: no job runs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import ERROR_MISSING_FIELDS, ERROR_NO_COLUMN


def column(name: str) -> Column:
    """Reference a column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Everything that is not a number: text, booleans, dates and timestamps."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in skip]


def column_kinds(df: DataFrame) -> DataFrame:
    """One row per column: position, name, declared type and kind."""
    rows = [
        (i, f.name, f.dataType.simpleString(), "numeric" if is_numeric(f.dataType) else "categorical")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, kind string")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    present = set(df.columns)
    absent = [n for n in names if n not in present]
    if absent:
        raise ValueError(ERROR_MISSING_FIELDS.format(", ".join(absent)))


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(ERROR_NO_COLUMN.format(name))


def select_expected(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The model's columns in the model's order; extra columns are left out."""
    require_columns(df, names)
    return df.select(*[column(n) for n in names])


def features_of(df: DataFrame, target: str) -> DataFrame:
    require_column(df, target)
    return df.select(*[column(n) for n in df.columns if n != target])


def target_of(df: DataFrame, target: str) -> DataFrame:
    require_column(df, target)
    return df.select(column(target))
