"""Boosted trees with a joint loss for more than two classes.

Every round fits one regression tree per class to the same softmax residuals (multinomial LogitBoost, Friedman, Hastie and
Tibshirani, 2000): with p the class share that the trees so far give a row and y whether the row has the class, a tree
fits (y - p) / (p (1 - p)) under the weight p (1 - p), so a leaf holds the Newton step of its rows and a split gains what
second-order boosting gains. The trees of a round are grown side by side. Probabilities are the softmax of the class sums.

The class sums are a column that every round writes to the shared folder, where the next round reads it and then removes
it, so neither the plan, nor the disk, nor the work after the loss of an executor grows with the number of rounds.
"""

from __future__ import annotations

import uuid
from functools import partial

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scores import softmax
from tablewright.session import remove, together, written

# Fixed values of the method: the largest working response, and the smallest weight of a row.
MAX_RESPONSE = 4.0
MIN_WEIGHT = 1e-6


def fit_joint_boosting(
    train: DataFrame, n_classes: int, rounds: int, depth: int, step: float, seed: int, memory_mb: int, max_bins: int
) -> PipelineModel:
    """One stage of boosted trees per class, fitted jointly to ``train`` (features, label from 0); stage k adds ``margin_k``.

    Rows with other columns are accepted; a table without rows is an error of the tree learner. Equal seeds give equal
    trees.
    """
    scale = step * (n_classes - 1) / n_classes
    data = train.select("features", "label", F.array(*[F.lit(0.0)] * n_classes).alias("margins"))
    trees: list[list[DecisionTreeRegressionModel]] = [[] for _ in range(n_classes)]
    before = None
    for i in range(rounds):
        shares = data.withColumn("_p", softmax(F.col("margins")))
        todo = shares.select("features", *[c for k in range(n_classes) for c in _working(k)])
        learners = [
            DecisionTreeRegressor(
                labelCol=f"z_{k}", weightCol=f"w_{k}", predictionCol=f"f_{k}", maxDepth=depth, seed=seed + i, maxMemoryInMB=memory_mb, maxBins=max_bins
            )
            for k in range(n_classes)
        ]
        grown = together(train.sparkSession, *[partial(learner.fit, todo) for learner in learners])
        for k, tree in enumerate(grown):
            trees[k].append(tree)
            data = tree.transform(data)
        moved = F.array(*[F.element_at("margins", k + 1) + F.lit(scale) * F.col(f"f_{k}") for k in range(n_classes)])
        data = data.select("features", "label", moved.alias("margins"))
        if i + 1 < rounds:
            data, path = written(data, "margins")
            # nothing reads the sums of the round before any more
            remove(train.sparkSession, before)
            before = path
    remove(train.sparkSession, before)
    grown = [[tree._java_obj for tree in trees[k]] for k in range(n_classes)]
    return PipelineModel([as_stage(k, grown[k], [scale] * rounds, trees[k][0].numFeatures) for k in range(n_classes)])


def as_stage(k: int, trees: list, weights: list[float], n_features: int) -> GBTRegressionModel:
    """The (Java) trees of a class as one Spark model, which is saved, loaded and explained like any other."""
    gateway = SparkContext._active_spark_context._gateway
    jvm = gateway.jvm
    made = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"JointBoosting_{uuid.uuid4().hex[:12]}", *java_arrays(gateway, trees, weights), n_features)
    return GBTRegressionModel(made).setPredictionCol(f"margin_{k}")


def java_arrays(gateway, trees: list, weights: list[float]) -> tuple:
    held = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    by = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        held[i], by[i] = tree, float(weight)
    return held, by


def _working(k: int) -> list[Column]:
    """Working response and weight of a class."""
    p = F.element_at("_p", k + 1)
    weight = F.greatest(p * (1 - p), F.lit(MIN_WEIGHT))
    response = ((F.col("label") == k).cast("double") - p) / weight
    return [F.greatest(F.least(response, F.lit(MAX_RESPONSE)), F.lit(-MAX_RESPONSE)).alias(f"z_{k}"), weight.alias(f"w_{k}")]
