"""Feature engineering: dates, interactions, squares, frequency and target encodings, correlation pruning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import (
    BINARY,
    CORRELATION_DROP_ABOVE,
    DATE_PARSE_MIN_RATE,
    INTERACTION_MAX_NUMERIC,
    MULTICLASS,
)
from tablewright.functions.dates import date_parts, parse_date_text, parsed_date
from tablewright.functions.kinds import categorical_columns, column, is_temporal, numeric_columns
from tablewright.functions.values import as_double, without_nan
from tablewright.operators.correlation import correlation_pairs
from tablewright.operators.lookup import left_lookup, mapping_bytes
from tablewright.operators.target import Target
from tablewright.session import together


def date_parse_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null values that read as a date, per categorical column."""
    names = list(columns if columns is not None else categorical_columns(df))
    aggs = []
    for i, n in enumerate(names):
        dtype = df.schema[n].dataType
        c = column(n)
        ok = parse_date_text(c) if isinstance(dtype, T.StringType) else (c if is_temporal(dtype) else F.lit(None))
        aggs += [F.count(c).alias(f"n{i}"), F.count(ok).alias(f"p{i}")]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint, parsed bigint, rate double, is_date boolean")
    cells = df.agg(*aggs).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("non_null"), F.col(f"p{i}").alias("parsed"))
                    for i, n in enumerate(names)
                ]
            )
        )
    )
    rate = F.try_divide(F.col("parsed").cast("double"), F.col("non_null"))
    return cells.select("*", rate.alias("rate"), F.coalesce(rate >= DATE_PARSE_MIN_RATE, F.lit(False)).alias("is_date"))


def date_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    names = list(columns if columns is not None else categorical_columns(df))
    # A temporal column is a date column unless it is entirely NULL; either way no parsing is needed.
    found = {r["column"] for r in date_parse_rates(df, names).where("is_date").collect()}
    return [n for n in names if n in found]


def add_date_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Year, month and weekday columns at the end; the source columns go."""
    kept = [column(n) for n in df.columns if n not in columns]
    parts = [p for n in columns for p in date_parts(parsed_date(df, n), n)]
    return df.select(*kept, *parts)


def interaction_names(columns: Sequence[str]) -> tuple[list[tuple[str, str, str]], str | None]:
    """``(name, a, b)`` for every pair; none, with the reason, for more columns than products are made for."""
    made = len(columns) <= INTERACTION_MAX_NUMERIC
    pairs = [(f"{a}_x_{b}", a, b) for a, b in combinations(columns, 2)] if made else []
    return pairs, None if made else f"Skipped: products are made for up to {INTERACTION_MAX_NUMERIC} numeric columns, here are {len(columns)}"


def add_interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs, _ = interaction_names(columns)
    return df.select("*", *[(as_double(df, a) * as_double(df, b)).alias(n) for n, a, b in pairs])


def add_squares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[(as_double(df, n) * as_double(df, n)).alias(f"{n}_squared") for n in columns])


def target_number(df: DataFrame, target: Target) -> Column:
    """Numeric target: the value itself, or 1 for the larger of two classes. NULL stays NULL."""
    if target.problem_type != BINARY:
        return as_double(df, target.name)
    top = df.agg(F.max(without_nan(df, target.name)).alias("m")).first()["m"]
    return (without_nan(df, target.name) == F.lit(top)).cast("double")


def value_statistics(df: DataFrame, name: str, y: Column | None = None) -> DataFrame:
    """``(key, n, mean_y)`` per distinct non-null value; combined on the map side."""
    cells = df.select(without_nan(df, name).alias("key"), (y if y is not None else F.lit(None).cast("double")).alias("y"))
    return (
        cells.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))
    )


def add_value_encodings(
    df: DataFrame, columns: Sequence[str], y: Column | None = None, frequency: bool = True, fit_on: DataFrame | None = None
) -> DataFrame:
    """``{c}_freq`` and, with a target, ``{c}_target_enc`` from one table per column.

    Fitted on ``fit_on`` (default: the frame itself, as in whole-table encoding).
    """
    if not columns:
        return df
    base = fit_on if fit_on is not None else df
    counts = [F.count(without_nan(base, n)).alias(f"n{i}") for i, n in enumerate(columns)]
    sizes, totals = together(
        df.sparkSession,
        lambda: mapping_bytes(base, columns),
        lambda: base.agg(F.count(F.lit(1)).alias("rows"), *counts).first(),
    )
    out = df
    for i, n in enumerate(columns):
        payload = []
        table = value_statistics(base, n, y)
        if frequency:
            payload.append((F.col("n") / F.lit(max(totals[f"n{i}"], 1))).alias(f"{n}_freq"))
        if y is not None:
            payload.append(F.col("mean_y").alias(f"{n}_target_enc"))
        names = ([f"{n}_freq"] if frequency else []) + ([f"{n}_target_enc"] if y is not None else [])
        mapping = table.select("key", F.col("n").alias("_n"), *payload)
        out = left_lookup(out, n, mapping, names, sizes[n], "_n", totals["rows"], len(columns))
    return out


def add_frequency_encoding(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return add_value_encodings(df, columns, fit_on=fit_on)


def target_encoding_skipped(columns: Sequence[str], target: Target) -> str | None:
    if columns and target.problem_type == MULTICLASS:
        return "Skipped: a multiclass target has no mean to encode"
    return None


def add_target_encoding(
    df: DataFrame, columns: Sequence[str], target: Target, fit_on: DataFrame | None = None
) -> DataFrame:
    """Mean of the numeric target by value; unchanged for multiclass targets."""
    if not columns or target_encoding_skipped(columns, target):
        return df
    base = fit_on if fit_on is not None else df
    return add_value_encodings(df, columns, target_number(base, target), frequency=False, fit_on=fit_on)


def correlated_drops(df: DataFrame, columns: Sequence[str] | None = None) -> list[tuple[str, str, float]]:
    """``(dropped, kept, r)``: in pair order the second of two strongly correlated columns goes.

    Only the pairs above the limit reach the driver, as edges of a graph of columns; an edge whose ends are both still
    there takes its second end away.
    """
    names = list(columns if columns is not None else numeric_columns(df))
    place = {n: k for k, n in enumerate(names)}
    strong = correlation_pairs(df, names).where(F.abs("corr") > CORRELATION_DROP_ABOVE).collect()
    left, drops = set(names), []
    for e in sorted(strong, key=lambda e: (place[e["col_a"]], place[e["col_b"]])):
        if {e["col_a"], e["col_b"]} <= left:
            left.remove(e["col_b"])
            drops.append((e["col_b"], e["col_a"], round(abs(e["corr"]), 4)))
    return drops


@dataclass(frozen=True)
class FeatureReport:
    date_features: list[tuple[str, list[str]]] = field(default_factory=list)
    interaction_features: list[tuple[str, str, str]] = field(default_factory=list)
    interaction_skipped: str | None = None
    polynomial_features: list[tuple[str, str]] = field(default_factory=list)
    frequency_encoded: list[tuple[str, str]] = field(default_factory=list)
    target_encoded: list[tuple[str, str]] = field(default_factory=list)
    target_encoding_skipped: str | None = None
    dropped_correlated: list[tuple[str, str, float]] = field(default_factory=list)
    feature_count_before: int = 0
    feature_count_after: int = 0

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(step, source, made, r)``: the whole report as a table, a row per feature made, left out or dropped."""
        rows = [("date", source, made, None) for source, parts in self.date_features for made in parts]
        rows += [("interaction", f"{a}, {b}", made, None) for made, a, b in self.interaction_features]
        rows += [("square", source, made, None) for source, made in self.polynomial_features]
        rows += [("frequency", source, made, None) for source, made in self.frequency_encoded]
        rows += [("target_encoding", source, made, None) for source, made in self.target_encoded]
        rows += [("dropped", dropped, kept, float(r)) for dropped, kept, r in self.dropped_correlated]
        skipped = (("interaction_skipped", self.interaction_skipped), ("target_encoding_skipped", self.target_encoding_skipped))
        rows += [(step, None, why, None) for step, why in skipped if why is not None]
        rows += [("count", None, "before", float(self.feature_count_before)), ("count", None, "after", float(self.feature_count_after))]
        return spark.createDataFrame(rows, "step string, source string, made string, r double")
