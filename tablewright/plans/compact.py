"""Forests grown on a table of bins, a few trees in each task, and kept as arrays.

A forest on a noisy target has tens of thousands of nodes a tree. As arrays a node takes 24 bytes, and 8 more for each class
after the first; the trees lie in a folder, a row each, and neither growing nor scoring needs them all at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import tree_shap
from tablewright.plans.binned import Bins, Tree, grow, pruned
from tablewright.session import scratch_path

#: Trees that a task grows, classes up to which a node holds a number for each, and rows that walk down a tree together.
TREES_PER_TASK, MOST_CLASSES, ROWS_AT_ONCE = 5, 32, 8192
#: Nodes that a worker keeps between batches of rows; more are read again from its own disk.
NODES_HELD = 5_000_000

_SCHEMA = "tree int, nodes int, feature binary, bin binary, left binary, cover binary, value binary"


class CompactForest(Model, MLWritable, MLReadable):
    """``classes`` is 0 for a regression. The trees lie in ``path``, a row each."""

    def __init__(self, path: str, cuts: list[list[float]], classes: int, trees: int) -> None:
        super().__init__()
        self.path, self.cuts, self.classes, self.n_trees = path, cuts, classes, trees
        self._held: list[Broadcast] | None = None

    @property
    def outputs(self) -> int:
        return max(1, self.classes)

    def groups(self, spark: SparkSession) -> Iterator[list[dict[str, np.ndarray]]]:
        """The trees in groups of about a million nodes, as dictionaries of arrays."""
        data = spark.read.schema(_SCHEMA).parquet(self.path)
        sizes = sorted((r["tree"], r["nodes"]) for r in data.select("tree", "nodes").collect())
        for first, last in tree_shap._tree_groups(sizes):
            rows = data.where(F.col("tree").between(first, last)).toArrow().sort_by("tree")
            yield [self._arrays(r) for r in rows.to_pylist()]

    def _arrays(self, row: dict) -> dict[str, np.ndarray]:
        kinds = {"feature": np.int16, "bin": np.int16, "left": np.int32, "cover": np.float64, "value": np.float64}
        out = {name: np.frombuffer(row[name], kind) for name, kind in kinds.items()}
        return {**out, "tree": row["tree"], "value": out["value"].reshape(-1, self.outputs)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        if self._held is None:
            self._held = [spark.sparkContext.broadcast([_walked(t) for t in group]) for group in self.groups(spark)]
        held, cuts, outputs, trees = self._held, [np.array(c) for c in self.cuts], self.outputs, self.n_trees

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                if not len(rows):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(rows.to_numpy()).astype(float)
                out, met = np.zeros((len(x), outputs)), 0
                bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8)
                for group in held:
                    for tree in group.value:
                        met += len(tree["left"])
                        for start in range(0, len(x), ROWS_AT_ONCE):
                            out[start : start + ROWS_AT_ONCE] += tree["value"][_leaves(tree, bins[:, start : start + ROWS_AT_ONCE])]
                    if met > NODES_HELD:
                        group.__dict__.pop("_value", None)
                yield pd.Series(list(out / trees))

        found = dataset.withColumn("_scores", scores(vector_to_array("features")))
        if not self.classes:
            return found.withColumn("prediction", F.get("_scores", F.lit(0))).drop("_scores")
        top = F.array_position("_scores", F.array_max("_scores")) - 1
        return found.withColumns({"probability": array_to_vector("_scores"), "prediction": top.cast("double")}).drop("_scores")

    def ensembles(self, spark: SparkSession) -> Iterator[tree_shap.Ensemble]:
        """For attributions, a group of trees at a time; base and contributions of the groups add up."""
        cuts = [np.array([*c, 0.0]) for c in self.cuts]
        for group in self.groups(spark):
            start = np.cumsum([0, *[len(t["left"]) for t in group]])
            joined = {name: np.concatenate([t[name] for t in group]) for name in ("feature", "bin", "left", "cover", "value")}
            left = np.concatenate([np.where(t["left"] < 0, -1, t["left"].astype(np.int64) + s) for t, s in zip(group, start)])
            threshold = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(joined["feature"].tolist(), joined["bin"].tolist())])
            nodes = tree_shap.Nodes(
                np.concatenate([np.full(len(t["left"]), t["tree"], np.int64) for t in group]), left, np.where(left < 0, -1, left + 1),
                joined["feature"].astype(np.int64), threshold, joined["cover"], joined["value"] / self.n_trees,
            )
            yield tree_shap._ensemble(nodes, len(self.cuts))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: CompactForest) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"cuts": m.cuts, "classes": m.classes, "trees": m.n_trees})
        self.sparkSession.read.schema(_SCHEMA).parquet(m.path).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> CompactForest:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = CompactForest(f"{path}/trees", about["cuts"], about["classes"], about["trees"])
        model._resetUid(about["uid"])
        return model


def _walked(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tree for walking: a leaf is its own left child, and no bin is right of its cut."""
    leaf = tree["left"] < 0
    at = np.arange(len(leaf), dtype=np.int32)
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := level[~leaf[level]]):
        level = np.r_[tree["left"][level], tree["left"][level] + 1]
        depth += 1
    return {
        "feature": np.where(leaf, 0, tree["feature"]).astype(np.int32), "bin": np.where(leaf, 256, tree["bin"]).astype(np.int16),
        "left": np.where(leaf, at, tree["left"]), "value": tree["value"], "depth": depth,
    }


def _leaves(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    flat, n = np.ascontiguousarray(bins).ravel(), bins.shape[1]
    where, at = np.arange(n), np.zeros(n, np.int32)
    for _ in range(tree["depth"]):
        at = tree["left"][at] + (flat[tree["feature"][at] * n + where] > tree["bin"][at])
    return at


def grow_forest(spark: SparkSession, table: Broadcast, cuts: tuple[np.ndarray, ...], classes: int, trees: int, depth: int, subset: str, seed: int) -> CompactForest:
    """Bootstrapped trees, each from a generator of its own, so they do not depend on how they are dealt to tasks."""
    n_features = len(cuts)
    per_node = math.ceil(math.sqrt(n_features)) if subset == "sqrt" else n_features
    per_task = TREES_PER_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Bins = table.value
        centre = float(np.average(rows.label, weights=rows.count))
        for task in [int(k) for b in batches for k in b.column(0).to_pylist()]:
            for number in range(task * per_task, min(trees, (task + 1) * per_task)):
                rng = np.random.default_rng([seed & 0xFFFFFFFF, number])
                weight = rng.poisson(rows.count).astype(float)
                if classes:
                    tree = pruned(grow(rows, np.stack([weight * (rows.label == k) for k in range(classes)]), True, depth, per_node, rng)[0])
                else:
                    y = rows.label - centre
                    tree = grow(rows, np.stack([weight, weight * y, weight * y * y]), False, depth, per_node, rng)[0]
                yield _row(number, tree, classes, centre)

    path = scratch_path(spark, "forest")
    tasks = -(-trees // per_task)
    spark.range(0, tasks, numPartitions=tasks).mapInArrow(run, _SCHEMA).write.parquet(path)
    return CompactForest(path, [[float(v) for v in c] for c in cuts], classes, trees)


def _row(number: int, tree: Tree, classes: int, centre: float) -> pa.RecordBatch:
    cover = tree.stats.sum(axis=0) if classes else tree.stats[0]
    value = (tree.stats / cover).T if classes else tree.stats[1] / cover + centre
    blobs = [tree.feature.astype(np.int16), tree.bin.astype(np.int16), tree.left.astype(np.int32), cover.astype(np.float64), np.ascontiguousarray(value, np.float64)]
    columns = [pa.array([number], pa.int32()), pa.array([len(cover)], pa.int32()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "nodes", "feature", "bin", "left", "cover", "value"])
