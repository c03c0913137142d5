"""Fitting and applying the whole pre-processing chain."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.constants import OUTLIER_METHOD, SCALING_METHOD
from tablewright.functions.kinds import (
    categorical_columns,
    column,
    is_numeric,
    numeric_columns,
    require_columns,
)
from tablewright.functions.values import as_double, as_text, without_nan
from tablewright.operators.encode import apply_ordinal, cardinality_split, encoding_rows, one_hot, ordinal_codes
from tablewright.operators.frequencies import text_frequencies
from tablewright.operators.impute import (
    category_modes,
    clip_counts,
    clipped,
    filled,
    missing_value_plan,
    scaled,
    scaler_of,
)
from tablewright.operators.lookup import ROW_OVERHEAD_BYTES, mapping_bytes
from tablewright.operators.quantiles import numeric_summaries
from tablewright.operators.split import Split, fit_split
from tablewright.operators.target import Target
from tablewright.session import together


@dataclass(frozen=True)
class NumericStep:
    name: str
    fill: float
    mean: float
    scale: float


@dataclass(frozen=True)
class OneHotStep:
    name: str
    fill: str
    categories: list[str]


@dataclass(frozen=True)
class OrdinalStep:
    name: str
    fill: str
    size_bytes: int
    total_rows: int


@dataclass
class FittedPreprocessor:
    """Literals for numbers and few-valued columns, one code table per many-valued column.

    Feature order: numbers, one-hot columns, ordinal codes; columns not listed
    in a step are left out.
    """

    numeric: list[NumericStep]
    one_hot: list[OneHotStep]
    ordinal: list[OrdinalStep]
    codes: dict[str, DataFrame] = field(default_factory=dict)
    excluded: list[str] = field(default_factory=list)

    @property
    def input_columns(self) -> list[str]:
        return [s.name for s in [*self.numeric, *self.one_hot, *self.ordinal]]

    @property
    def feature_names(self) -> list[str]:
        names = [s.name for s in self.numeric]
        for s in self.one_hot:
            names += [f"{s.name}_{c}" for c in s.categories]
        return names + [s.name for s in self.ordinal]

    def standardised(self, df: DataFrame) -> dict[str, Column]:
        return {s.name: scaled(filled(as_double(df, s.name), s.fill), s.mean, s.scale) for s in self.numeric}

    def feature_frame(self, df: DataFrame, clip: bool = False, prefix: str = "_f") -> DataFrame:
        """``df`` plus one column per feature, named by prefix and position."""
        require_columns(df, self.input_columns)
        out = list(df.columns)
        wide = df
        for i, s in enumerate(self.ordinal):
            wide = wide.withColumn(f"_o{i}", filled(without_nan(df, s.name), F.lit(s.fill).cast(df.schema[s.name].dataType)))
            wide = apply_ordinal(wide, f"_o{i}", self.codes[s.name], s.size_bytes, s.total_rows, f"_c{i}", len(self.codes))
        features: list[Column] = []
        for z in self.standardised(df).values():
            features.append(clipped(z) if clip else z)
        for s in self.one_hot:
            features += one_hot(filled(as_text(df, s.name), s.fill), s.name, s.categories)
        features += [F.col(f"_c{i}") for i in range(len(self.ordinal))]
        return wide.select(
            *[column(n) for n in out], *[f.alias(f"{prefix}{i}") for i, f in enumerate(features)]
        )

    def transform(self, df: DataFrame, clip: bool = False, output: str = "features") -> DataFrame:
        frame = self.feature_frame(df, clip)
        inputs = [f"_f{i}" for i in range(len(self.feature_names))]
        return VectorAssembler(inputCols=inputs, outputCol=output).transform(frame).drop(*inputs)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a new folder; one that holds a preprocessor already is an error, so none is read while it is replaced."""
        state = {
            "numeric": [asdict(s) for s in self.numeric],
            "one_hot": [asdict(s) for s in self.one_hot],
            "ordinal": [asdict(s) for s in self.ordinal],
            "excluded": self.excluded,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(f"{path}/state")
        for i, s in enumerate(self.ordinal):
            self.codes[s.name].write.parquet(f"{path}/codes-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPreprocessor:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        ordinal = [OrdinalStep(**s) for s in state["ordinal"]]
        return cls(
            [NumericStep(**s) for s in state["numeric"]],
            [OneHotStep(**s) for s in state["one_hot"]],
            ordinal,
            {s.name: spark.read.parquet(f"{path}/codes-{i}") for i, s in enumerate(ordinal)},
            state["excluded"],
        )


def fit_preprocessor(
    train: DataFrame, train_rows: int, numeric: Sequence[str], low: Sequence[str], high: Sequence[str]
) -> FittedPreprocessor:
    """All statistics come from the training rows.

    Columns without a single training value cannot be filled or encoded and are
    reported in ``excluded``.
    """
    numeric, low, high = list(numeric), list(low), list(high)
    # at most ten values per column come back for the one-hot columns
    summaries, tallies, mode_of, sizes = together(
        train.sparkSession,
        lambda: numeric_summaries(train, numeric),
        lambda: text_frequencies(train, low).collect() if low else [],
        lambda: category_modes(train, high),
        lambda: mapping_bytes(train, high),
    )
    excluded = [n for n in numeric if not summaries[n].count]
    steps = []
    for n in numeric:
        if n not in excluded:
            mean, scale = scaler_of(summaries[n])
            steps.append(NumericStep(n, summaries[n].median, mean, scale))

    hot, seen = [], {}
    for r in tallies:
        seen.setdefault(r["column"], []).append((r["value"], r["count"]))
    for n in low:
        if n not in seen:
            excluded.append(n)
            continue
        fill = min(seen[n], key=lambda vc: (-vc[1], vc[0]))[0]
        hot.append(OneHotStep(n, fill, sorted(v for v, _ in seen[n])))

    ordinal, codes = [], {}
    for n in high:
        if n not in mode_of:
            excluded.append(n)
            continue
        codes[n] = ordinal_codes(train, n, rows_hint=sizes[n] // ROW_OVERHEAD_BYTES)
        ordinal.append(OrdinalStep(n, mode_of[n], sizes[n], train_rows))
    return FittedPreprocessor(steps, hot, ordinal, codes, excluded)


@dataclass(frozen=True)
class PreprocessingReport:
    target_column: str
    problem_type: str
    feature_count_before: int
    feature_count_after: int
    missing_values: DataFrame
    encoding: DataFrame
    scaling_method: str
    scaling_columns: list[str]
    outlier_method: str
    outlier_clips: DataFrame
    train_rows: int
    test_rows: int
    test_size: float
    stratified: bool
    dropped_rows: int
    excluded_columns: list[str]

    @property
    def total_clipped(self) -> int:
        """Values beyond the outlier limit, over all columns."""
        return self.outlier_clips.agg(F.coalesce(F.sum("clipped_count"), F.lit(0)).alias("n")).first()["n"]

    def rows(self, spark: SparkSession) -> DataFrame:
        """``(section, column, detail, n)``: the whole report as a table, a row per column and step."""
        sizes = {
            "feature_count_before": self.feature_count_before, "feature_count_after": self.feature_count_after, "train_rows": self.train_rows,
            "test_rows": self.test_rows, "dropped_rows": self.dropped_rows, "total_clipped": self.total_clipped,
        }
        fixed = [("size", None, name, int(n)) for name, n in sizes.items()]
        fixed += [("scaling", c, self.scaling_method, None) for c in self.scaling_columns]
        fixed += [("excluded", c, None, None) for c in self.excluded_columns]
        table = spark.createDataFrame(fixed, _REPORT_ROW)
        part = lambda df, section, detail, n: df.select(F.lit(section).alias("section"), "column", detail.alias("detail"), F.col(n).cast("bigint").alias("n"))
        for df, section, detail, n in (
            (self.missing_values, "missing", F.col("strategy"), "missing_count"),
            (self.encoding, "encoding", F.col("strategy"), "categories_count"),
            (self.outlier_clips, "outliers", F.lit(self.outlier_method), "clipped_count"),
        ):
            table = table.unionByName(part(df, section, detail, n))
        return table


_REPORT_ROW = "section string, column string, detail string, n bigint"


@dataclass
class Preprocessed:
    preprocessor: FittedPreprocessor
    split: Split
    source: DataFrame
    target: Target
    numeric: list[str]
    low: dict[str, int]
    high: list[str]

    @cached_property
    def report(self) -> PreprocessingReport:
        """Computed when first asked for; fitting does not need it."""
        df, names = self.source, [*self.numeric, *self.low, *self.high]
        known = df.where(without_nan(df, self.target.name).isNotNull())
        return PreprocessingReport(
            target_column=self.target.name,
            problem_type=self.target.problem_type,
            feature_count_before=len(names),
            feature_count_after=len(self.preprocessor.feature_names),
            missing_values=missing_value_plan(df.select(*[column(n) for n in names])),
            encoding=encoding_rows(df, self.low, self.high),
            scaling_method=SCALING_METHOD,
            scaling_columns=[s.name for s in self.preprocessor.numeric],
            outlier_method=OUTLIER_METHOD,
            outlier_clips=clip_counts(known, self.preprocessor.standardised(known)),
            train_rows=self.split.train_rows,
            test_rows=self.split.test_rows,
            test_size=self.split.test_size,
            stratified=self.split.stratified,
            dropped_rows=self.split.dropped_rows,
            excluded_columns=self.preprocessor.excluded,
        )

    def features(self, part: str, keep: Sequence[str] = ()) -> DataFrame:
        """Clipped feature vectors of the ``train`` or ``test`` rows with the target."""
        rows = self.split.train(self.source) if part == "train" else self.split.test(self.source)
        out = self.preprocessor.transform(rows, clip=True)
        kept = dict.fromkeys([*keep, self.split.target])
        return out.select(*[column(n) for n in kept], "features")


def preprocess(
    df: DataFrame,
    target: Target,
    key: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> Preprocessed:
    """Split, then fit on the training rows; the report covers the whole table.

    ``exclude`` names columns that are neither target nor feature, such as row keys.
    """
    skip = [target.name, *exclude]
    usable = [f.name for f in df.schema.fields if is_numeric(f.dataType) or not _nested(f.dataType)]
    numeric = [n for n in numeric_columns(df, skip) if n in usable]
    categorical = [n for n in categorical_columns(df, skip) if n in usable]
    (low, high), split = together(
        df.sparkSession, lambda: cardinality_split(df, categorical), lambda: fit_split(df, target, key)
    )
    fitted = fit_preprocessor(split.train(df), split.train_rows, numeric, list(low), high)
    return Preprocessed(fitted, split, df, target, numeric, low, high)


def _nested(dtype) -> bool:
    return dtype.typeName() in ("array", "map", "struct", "binary")
