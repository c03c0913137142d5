"""Forests grown in parts that train side by side.

Spark's learner makes the counts of every node of a pass in every partition, so below the first levels, where a node has a
few rows, a forest over many partitions does the same work in each of them. The trees of a forest do not depend on each
other: a part of them on few partitions costs a fraction of it, and many parts fill the cores.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark import SparkContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame

from tablewright.session import together

#: Trees of a part; their number does not follow the cluster.
PART_TREES = 10
#: Rows up to which a forest is one part, and the most of a partition of a part: it keeps a weight and a position for each row and tree.
WHOLE_ROWS, PARTITION_ROWS = 10_000, 100_000
#: Between the seeds of two parts: a learner adds the number of a partition to its seed.
SEED_STEP = 1_000_003


def fit_forest(
    estimator: RandomForestClassifier | RandomForestRegressor, train: DataFrame
) -> RandomForestClassificationModel | RandomForestRegressionModel:
    """The forest of ``estimator`` on ``train``, which every part reads, so it had better be persisted."""
    trees, rows = estimator.getNumTrees(), train.count()
    if trees <= PART_TREES or rows <= WHOLE_ROWS:
        return estimator.fit(train)
    partitions = -(-rows // PARTITION_ROWS)
    held = train.coalesce(partitions)
    cores = train.sparkSession.sparkContext.defaultParallelism
    starts = range(0, trees, PART_TREES)
    # a part waits for the driver between its passes, so there are more parts than cores to fill
    at_once = min(len(starts), max(2, 2 * cores // partitions))
    memory = max(1, estimator.getMaxMemoryInMB() // at_once)
    parts = [
        estimator.copy(
            {
                estimator.numTrees: min(PART_TREES, trees - start),
                estimator.seed: estimator.getSeed() + SEED_STEP * i,
                estimator.maxMemoryInMB: memory,
            }
        )
        for i, start in enumerate(starts)
    ]
    grown = together(train.sparkSession, *[partial(part.fit, held) for part in parts], at_once=at_once)
    forest = estimator._copyValues(_joined(grown))
    forest._transfer_params_to_java()
    return forest


def _joined(parts: list) -> RandomForestClassificationModel | RandomForestRegressionModel:
    """All trees of the parts as one Spark model, which is saved, loaded and explained like any other."""
    gateway = SparkContext._active_spark_context._gateway
    jvm, first = gateway.jvm, parts[0]
    classes = isinstance(first, RandomForestClassificationModel)
    package = jvm.org.apache.spark.ml.classification if classes else jvm.org.apache.spark.ml.regression
    kind = package.DecisionTreeClassificationModel if classes else package.DecisionTreeRegressionModel
    trees = [tree for part in parts for tree in part._java_obj.trees()]
    held = gateway.new_array(kind, len(trees))
    for i, tree in enumerate(trees):
        held[i] = tree
    name = f"Forest_{uuid.uuid4().hex[:12]}"
    if classes:
        made = package.RandomForestClassificationModel(name, held, first.numFeatures, first.numClasses)
        return RandomForestClassificationModel(made)
    return RandomForestRegressionModel(package.RandomForestRegressionModel(name, held, first.numFeatures))
