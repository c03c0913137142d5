"""CSV in, with validation, null tokens and type inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.constants import ERROR_NO_DATA, ERROR_NOT_CSV
from tablewright.functions.kinds import column
from tablewright.functions.values import (
    null_token_to_null,
    text_is_boolean,
    text_is_integer,
    text_is_number,
    text_to_number,
)

_BASE = {"quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": "", "emptyValue": ""}


def _is_csv(path: str) -> bool:
    return path.rstrip("/").lower().endswith(".csv")


def read_text_csv(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every column as text, null tokens as NULL.

    ``path`` may be a file, a folder written by Spark, or a list; names must
    end in ``.csv``. Set ``multiline`` when quoted cells hold line breaks: such
    a file cannot be split, so write large data as many files. ``columns``
    prunes the read. Files whose header differs in names or order from the first
    one are an error (not checked if a column has no name).
    """
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not _is_csv(p):
            raise ValueError(ERROR_NOT_CSV)
    head = spark.read.options(**_BASE).option("multiLine", multiline).option("header", False).csv(paths)
    first = head.first() if head.columns else None
    if first is None:
        raise ValueError("CSV file is empty")
    names = ["" if n is None else n for n in first]
    doubled = sorted({n for n in names if names.count(n) > 1 and n})
    if doubled:
        raise ValueError(f"CSV header repeats column names: {', '.join(doubled)}")
    df = (
        spark.read.options(**_BASE)
        .option("multiLine", multiline)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", not all(names))
        .csv(paths, schema=", ".join(f"`{n.replace('`', '``')}` string" for n in (x or f"_c{i}" for i, x in enumerate(names))))
    )
    if columns is not None:
        df = df.select(*[column(n) for n in columns])
    if df.isEmpty():
        raise ValueError(ERROR_NO_DATA)
    return df.select(*[null_token_to_null(column(n)).alias(n) for n in df.columns])


def type_counts(text: DataFrame) -> DataFrame:
    """Per column: non-null cells and how many read as integer, number or boolean, with the inferred type."""
    names = text.columns
    long = (
        text.unpivot([], [column(n) for n in names], "column", "value")
        if len(names) > 1
        else text.select(F.lit(names[0]).alias("column"), column(names[0]).alias("value"))
    )
    v = F.col("value")
    # One code per cell, so that an integer costs a single pattern match.
    code = (
        F.when(v.isNull(), "missing")
        .when(text_is_integer(v), "integer")
        .when(text_is_number(v), "number")
        .when(text_is_boolean(v), "boolean")
        .otherwise("text")
    )
    cells = long.groupBy("column", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda *codes: F.sum(F.when(F.col("code").isin(*codes), F.col("n")).otherwise(0))
    counts = cells.groupBy("column").agg(
        of("integer", "number", "boolean", "text").alias("non_null"),
        F.sum("n").alias("rows"),
        of("integer").alias("integers"),
        of("integer", "number").alias("numbers"),
        of("boolean").alias("booleans"),
    )
    full = F.col("non_null")
    inferred = (
        F.when(full == 0, "double")
        .when((F.col("integers") == full) & (full == F.col("rows")), "bigint")
        .when(F.col("numbers") == full, "double")
        .when((F.col("booleans") == full) & (full == F.col("rows")), "boolean")
        .otherwise("string")
    )
    return counts.select("column", "non_null", "integers", "numbers", "booleans", inferred.alias("inferred"))


def infer_types(text: DataFrame) -> DataFrame:
    """Integers, then decimals, then booleans, else text; integers with gaps become decimals."""
    kinds = {r["column"]: r["inferred"] for r in type_counts(text).collect()}
    out = []
    for n in text.columns:
        c, kind = column(n), kinds[n]
        if kind == "bigint":
            c = F.trim(c).cast("bigint")
        elif kind == "double":
            c = text_to_number(c)
        elif kind == "boolean":
            c = F.lower(c) == "true"
        out.append(c.alias(n))
    return text.select(*out)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """A validated CSV with inferred types. Reads the header, then counts types, then is lazy."""
    return infer_types(read_text_csv(spark, path, multiline, columns))
