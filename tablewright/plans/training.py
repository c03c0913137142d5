"""Model suite: fit, judge on the test rows, rank, keep."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark import Broadcast, SparkContext, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.stat import Summarizer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.constants import FOREST_TREES, LOGISTIC_MAX_ITER, PARAM_TEXT_MAX_CHARS, SEED
from tablewright.functions.values import as_double
from tablewright.operators.encode import label_encode
from tablewright.operators.metrics import binary_roc_auc, classification_metrics, ovr_roc_auc, regression_metrics
from tablewright.operators.target import Target, class_labels
from tablewright.plans import rounds
from tablewright.plans.binned import LEAST_ROWS as LEAST_BINNED
from tablewright.plans.binned import Bins, bin_table
from tablewright.plans.boosting import as_stage, fit_joint_boosting
from tablewright.plans.compact import MOST_CLASSES, grow_forest
from tablewright.plans.forest import fit_forest
from tablewright.plans.model import ScoringModel, model_scores
from tablewright.plans.preprocess import Preprocessed
from tablewright.session import checkpoint_folder, together

#: Training rows for which a partition of their own is worth a task in every pass of a learner, and the most that one task
#: gets: a forest keeps a weight and a position for each of them and each tree.
LEAST_ROWS, MOST_ROWS = 10_000, 25_000

RUN_SCHEMA = (
    "run_id bigint, dataset_id bigint, target_column string, problem_type string, "
    "class_labels array<string>, created_at timestamp"
)
RESULT_SCHEMA = (
    "run_id bigint, result_id bigint, model_name string, accuracy double, precision double, recall double, "
    "f1 double, roc_auc double, mae double, rmse double, r2 double, training_time_seconds double, "
    "params map<string,string>, created_at timestamp, model_path string"
)


@dataclass(frozen=True)
class Boosting:
    """A gradient-boosted-trees setting; the three presets trade speed against fineness."""

    rounds: int
    depth: int
    step: float


@dataclass(frozen=True)
class SuiteOptions:
    trees: int = FOREST_TREES
    forest_depth: int = 30  # the most that Spark grows
    boosting: Mapping[str, Boosting] = field(
        default_factory=lambda: {
            "gbt_fast": Boosting(100, 6, 0.3),
            "gbt_leaf": Boosting(100, 5, 0.1),
            "gbt_slow": Boosting(200, 6, 0.03),
        }
    )
    max_iter: int = LOGISTIC_MAX_ITER
    seed: int = SEED
    # Larger groups of tree nodes per pass over the data.
    tree_memory_mb: int = 1024
    # Candidate cuts of a feature.
    max_bins: int = 32
    # Rounds of levels after which a forest's row positions are written; they save shipping the trees to every task.
    checkpoint_levels: int = 10
    # Models that train side by side; 1 for training times that can be compared.
    parallel: int = 5


def estimators(target: Target, n_train: int, options: SuiteOptions = SuiteOptions()) -> dict[str, Estimator]:
    """Unfitted models by name. The logistic penalty equals C = 1 on the summed loss."""
    o = options
    tree = {"seed": o.seed, "maxMemoryInMB": o.tree_memory_mb, "maxBins": o.max_bins}
    deep = {**tree, "cacheNodeIds": True, "checkpointInterval": o.checkpoint_levels}
    if target.is_classification:
        out: dict[str, Estimator] = {
            "logistic_regression": LogisticRegression(
                maxIter=o.max_iter, regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False
            ),
            "random_forest": RandomForestClassifier(
                numTrees=o.trees, maxDepth=o.forest_depth, featureSubsetStrategy="sqrt", **deep
            ),
        }
        boosted = GBTClassifier
    else:
        out = {
            "linear_regression": LinearRegression(regParam=0.0, maxIter=o.max_iter),
            "random_forest": RandomForestRegressor(
                numTrees=o.trees, maxDepth=o.forest_depth, featureSubsetStrategy="all", **deep
            ),
        }
        boosted = GBTRegressor
    for name, b in o.boosting.items():
        out[name] = boosted(maxIter=b.rounds, maxDepth=b.depth, stepSize=b.step, **tree)
    return out


_FORESTS, _BOOSTED = (RandomForestClassifier, RandomForestRegressor), (GBTClassifier, GBTRegressor)


def fit_model(estimator: Estimator, train: DataFrame, n_classes: int, table: Broadcast | None = None) -> PipelineModel:
    """One stage, or one per class of a joint loss where Spark's learner only knows two classes. Trees grow on the ``table`` of
    the training rows where there is one."""
    if table is not None and isinstance(estimator, _FORESTS + _BOOSTED):
        return PipelineModel(_on_table(estimator, train.sparkSession, table, n_classes))
    checkpoint_folder(train.sparkSession)
    if isinstance(estimator, (RandomForestClassifier, RandomForestRegressor)):
        return PipelineModel([_without_summary(fit_forest(estimator, train))])
    if isinstance(estimator, GBTClassifier) and n_classes > 2:
        e = estimator
        return fit_joint_boosting(train, n_classes, e.getMaxIter(), e.getMaxDepth(), e.getStepSize(), e.getSeed(), e.getMaxMemoryInMB(), e.getMaxBins())
    return PipelineModel([_without_summary(estimator.fit(train))])


def _on_table(e: Estimator, spark: SparkSession, table: Broadcast, n_classes: int) -> list[Model]:
    cuts = table.value.cuts
    if isinstance(e, _FORESTS):
        return [grow_forest(spark, table, cuts, n_classes, e.getNumTrees(), e.getMaxDepth(), e.getFeatureSubsetStrategy(), e.getSeed())]
    size, step = (e.getMaxIter(), e.getMaxDepth()), e.getStepSize()
    if n_classes > 2:
        trees = rounds.in_task(spark, table, lambda t: rounds.joint(t, n_classes, *size, step))
        grown, scale = rounds.java_trees(spark, trees, cuts, len(cuts)), step * (n_classes - 1) / n_classes
        return [as_stage(k, grown[k::n_classes], [scale] * e.getMaxIter(), len(cuts)) for k in range(n_classes)]
    learner = rounds.logistic if n_classes else rounds.squared
    grown = rounds.java_trees(spark, rounds.in_task(spark, table, lambda t: learner(t, *size, step)), cuts, len(cuts))
    return [rounds.spark_model(e, grown, [1.0] + [step] * (len(grown) - 1), len(cuts))]


def _table(train: DataFrame, rows: int, n_features: int, labels: int, todo: Mapping[str, Estimator], options: SuiteOptions) -> Broadcast | None:
    """The table of the training rows where a learner of trees is among the models and can use it; small tables go to Spark's learners."""
    if rows <= LEAST_BINNED or labels == 1 or labels > MOST_CLASSES or not any(isinstance(e, _FORESTS + _BOOSTED) for e in todo.values()):
        return None
    bins: Bins | None = bin_table(train, rows, n_features, options.max_bins, options.seed)
    return None if bins is None else train.sparkSession.sparkContext.broadcast(bins)


def _without_summary(model: Model) -> Model:
    """The model without the summary of its training, which would tie it to the training rows and to the session; a session
    that observes what it writes cannot be sent along with a model."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.apply(None))
    return model


_SCALAR_PARAMS = {TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toString, TypeConverters.toBoolean}


def loggable_params(estimator: Estimator) -> dict[str, str]:
    """The settings in force whose declared type is a number, a text or a switch; long texts are left out."""
    in_force = [p for p in estimator.params if p.typeConverter in _SCALAR_PARAMS and estimator.isDefined(p)]
    texts = {p.name: str(estimator.getOrDefault(p)) for p in in_force}
    return {name: text for name, text in texts.items() if len(text) <= PARAM_TEXT_MAX_CHARS}


def judge(scored: DataFrame, target: Target, n_classes: int) -> dict[str, float | None]:
    """Metrics of rows with ``label``, and ``scores`` (classification) or ``value``."""
    if not target.is_classification:
        return regression_metrics(scored, "label", "value").first().asDict()
    rows = scored.withColumn("decided", (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))
    found = classification_metrics(rows, "label", "decided", 1.0 if target.is_binary else None).first().asDict()
    if target.is_binary:
        area = binary_roc_auc(rows.withColumn("p", F.element_at("scores", 2)), "label", "p", 1.0)
    else:
        area = ovr_roc_auc(rows, "label", F.col("scores"), n_classes)
    return {**found, "roc_auc": area.first()["roc_auc"]}


@dataclass
class Suite:
    run: DataFrame
    results: DataFrame
    models: dict[str, ScoringModel]


def run_suite(
    prepared: Preprocessed,
    target: Target,
    options: SuiteOptions = SuiteOptions(),
    names: Sequence[str] | None = None,
    run_id: int | None = None,
    dataset_id: int = 1,
    folder: str | None = None,
) -> Suite:
    """Fit the models on the same training rows and compare them on the same test rows.

    ``run_id`` is the time in microseconds unless given. With a ``folder`` every
    model is saved below it, in a folder of its run and name that its result names.
    """
    df = prepared.source
    spark = df.sparkSession
    labels = class_labels(df, target.name) if target.is_classification else []
    train = _spread(_labelled(prepared.features("train"), target, labels), prepared.split.train_rows).persist(StorageLevel.MEMORY_AND_DISK)
    test = _labelled(prepared.features("test"), target, labels).persist(StorageLevel.MEMORY_AND_DISK)
    now = datetime.now(timezone.utc)
    run_id = int(now.timestamp() * 1_000_000) if run_id is None else run_id

    def one(number: int, name: str, estimator: Estimator) -> tuple[tuple, ScoringModel]:
        start = time.perf_counter()
        fitted = fit_model(estimator, train, len(labels), table)
        seconds = round(time.perf_counter() - start, 4)
        scored = model_scores(fitted, test, target, len(labels)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            m = judge(scored, target, len(labels))
        finally:
            scored.unpersist()
        found = [m.get(k) for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "mae", "rmse", "r2")]
        model = ScoringModel(
            name=name,
            target=target,
            labels=[str(v) for v in labels],
            feature_columns=[n for n in df.columns if n != target.name],
            preprocessor=prepared.preprocessor,
            fitted=fitted,
            train_means=means,
            schema=df.select(*prepared.preprocessor.input_columns).schema,
        )
        if folder is not None:
            model.save(spark, f"{folder}/models/run_{run_id}/{name}")
        return (run_id, number, name, *found, seconds, loggable_params(estimator), now, model.path), model

    try:
        means = _means(train, len(prepared.preprocessor.feature_names))
        todo = estimators(target, prepared.split.train_rows, options)
        todo = {n: e for n, e in todo.items() if names is None or n in names}
        table = _table(train, prepared.split.train_rows, len(prepared.preprocessor.feature_names), len(labels), todo, options)
        jobs = [partial(one, i, n, e) for i, (n, e) in enumerate(todo.items(), 1)]
        if table is not None and options.parallel > 1:
            # boosting is one long task a model, a forest many short ones that fill what is left
            jobs.sort(key=lambda job: isinstance(job.args[2], _FORESTS))
        done = sorted(together(spark, *jobs, at_once=options.parallel), key=lambda found: found[0][1])
    finally:
        train.unpersist()
        test.unpersist()
    rows, models = [row for row, _ in done], {model.name: model for _, model in done}
    run = spark.createDataFrame(
        [(run_id, dataset_id, target.name, target.problem_type, [str(v) for v in labels] or None, now)], RUN_SCHEMA
    )
    return Suite(run, spark.createDataFrame(rows, RESULT_SCHEMA), models)


def _labelled(df: DataFrame, target: Target, labels: Sequence) -> DataFrame:
    if target.is_classification:
        return label_encode(df, target.name, labels).select("features", "label")
    return df.select("features", as_double(df, target.name).alias("label"))


def _spread(train: DataFrame, rows: int) -> DataFrame:
    """``train`` over the cores of the cluster as far as its rows fill them, and over more where they are many: a file of one
    row group would keep a learner in one task."""
    wanted = max(min(train.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS), -(-rows // MOST_ROWS))
    return train.repartition(wanted) if train.rdd.getNumPartitions() < wanted else train


def _means(train: DataFrame, n: int) -> list[float]:
    return [float(v) for v in train.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()][:n]


def append_experiment(suite: Suite, folder: str) -> None:
    """Add a run and its results to the experiment tables."""
    suite.run.coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    suite.results.coalesce(1).write.mode("append").parquet(f"{folder}/results")


def read_experiments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/runs"),
        spark.read.schema(RESULT_SCHEMA).parquet(f"{folder}/results"),
    )



def load_result(spark: SparkSession, results: DataFrame, run_id: int, model_name: str) -> ScoringModel:
    """The model that a result of an earlier run names."""
    row = results.where((F.col("run_id") == run_id) & (F.col("model_name") == model_name)).select("model_path").first()
    if row is None or row["model_path"] is None:
        raise ValueError(f"no saved model '{model_name}' of run {run_id}")
    return ScoringModel.load(spark, row["model_path"])
