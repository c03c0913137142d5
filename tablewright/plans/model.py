"""A fitted model with its pre-processing: score, save, load, promote.

A saved model is a folder that is written once. The saved model of a project is
the one that the latest of its pointers names; a pointer is one row in one file
that appears when everything it points to is there, so a reader sees the model
before or the model after a promotion, and a promotion that breaks off changes
nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import column, require_columns
from tablewright.functions.scores import argmax_index, decode_label, softmax
from tablewright.functions.values import coerce_payload
from tablewright.operators.target import Target
from tablewright.plans.preprocess import FittedPreprocessor

META_SCHEMA = (
    "model_name string, target_column string, problem_type string, class_labels array<string>, "
    "feature_columns array<string>, train_means array<double>, input_schema string, saved_at timestamp"
)

POINTER_SCHEMA = "project_id bigint, version string, path string, saved_at timestamp"


def model_scores(fitted: PipelineModel, df: DataFrame, target: Target, n_classes: int) -> DataFrame:
    """Class probabilities as array ``scores``, or the number ``value``; the model's own columns are dropped."""
    out = fitted.transform(df)
    kept = [column(n) for n in df.columns]
    if not target.is_classification:
        return out.select(*kept, F.col("prediction").alias("value"))
    if len(fitted.stages) == 1:
        return out.select(*kept, vector_to_array("probability").alias("scores"))
    # one sum of trees per class
    return out.select(*kept, softmax(F.array(*[F.col(f"margin_{k}") for k in range(n_classes)])).alias("scores"))


@dataclass
class ScoringModel:
    name: str
    target: Target
    labels: list[str]
    feature_columns: list[str]
    preprocessor: FittedPreprocessor
    fitted: PipelineModel
    train_means: list[float]
    schema: T.StructType
    # the folder it was written to or read from
    path: str | None = None

    @property
    def required_columns(self) -> list[str]:
        return self.preprocessor.input_columns

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a new folder; an existing one is an error. The description comes last and marks the model as whole."""
        self.fitted.write().save(f"{path}/model")
        self.preprocessor.save(spark, f"{path}/preprocessor")
        row = (
            self.name, self.target.name, self.target.problem_type, self.labels or None, self.feature_columns,
            self.train_means, self.schema.json(), datetime.now(timezone.utc),
        )
        spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.parquet(f"{path}/meta")
        self.path = path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringModel:
        m = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
        return cls(
            name=m["model_name"],
            target=Target(m["target_column"], m["problem_type"]),
            labels=list(m["class_labels"] or []),
            feature_columns=list(m["feature_columns"]),
            preprocessor=FittedPreprocessor.load(spark, f"{path}/preprocessor"),
            fitted=PipelineModel.load(f"{path}/model"),
            train_means=list(m["train_means"]),
            schema=T.StructType.fromJson(json.loads(m["input_schema"])),
            path=path,
        )


def promote_model(spark: SparkSession, model: ScoringModel, folder: str, project_id: int) -> DataFrame:
    """Make a model the saved one of its project. A model that lies in a folder is pointed to, any other is written first."""
    if model.path is None:
        model.save(spark, f"{folder}/project_{project_id}/versions/{uuid.uuid4().hex}")
    return promote_saved(spark, model.path, folder, project_id)


def promote_saved(spark: SparkSession, path: str, folder: str, project_id: int) -> DataFrame:
    """Make the model in ``path``, such as one of an earlier run, the saved one of a project."""
    spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").select("model_name").first()  # an unfinished folder is an error here
    row = (project_id, uuid.uuid4().hex, path, datetime.now(timezone.utc))
    spark.createDataFrame([row], POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/project_{project_id}/pointers")
    return saved_model_info(spark, folder, project_id)


def promotions(spark: SparkSession, folder: str, project_id: int) -> DataFrame:
    """All pointers of a project, latest first."""
    rows = spark.read.schema(POINTER_SCHEMA).parquet(f"{folder}/project_{project_id}/pointers")
    return rows.orderBy(F.col("saved_at").desc(), F.col("version").desc())


def promoted_path(spark: SparkSession, folder: str, project_id: int) -> str:
    return promotions(spark, folder, project_id).first()["path"]


def saved_model_info(spark: SparkSession, folder: str, project_id: int) -> DataFrame:
    return spark.read.schema(META_SCHEMA).parquet(f"{promoted_path(spark, folder, project_id)}/meta").select(
        "model_name", "target_column", "problem_type", "class_labels", "feature_columns", "saved_at"
    )


def load_promoted(spark: SparkSession, folder: str, project_id: int) -> ScoringModel:
    return ScoringModel.load(spark, promoted_path(spark, folder, project_id))


def score(df: DataFrame, model: ScoringModel, clip: bool = False, coerce: bool = True) -> DataFrame:
    """All input columns with ``prediction`` and, for classes, ``probability``.

    Works on static and streaming frames. Text fields are converted to the
    types the model knows. Without ``clip`` outliers are scored as they come,
    as a saved model does.
    """
    require_columns(df, model.required_columns)
    typed = coerce_payload(df, model.schema) if coerce else df
    kept = list(df.columns)
    ready = model.preprocessor.transform(typed, clip=clip, output="features")
    scored = model_scores(model.fitted, ready, model.target, len(model.labels))
    base: Sequence = [column(n) for n in kept]
    if not model.target.is_classification:
        return scored.select(*base, F.col("value").alias("prediction"))
    index = argmax_index(F.col("scores"))
    return scored.select(*base, decode_label(index, model.labels).alias("prediction"), F.array_max("scores").alias("probability"))
