"""Path-dependent Shapley values of tree ensembles, by subset tables.

Along a root-to-leaf path every feature ``i`` has ``z_i``, the share of training rows that its splits let through. A row
either passes all splits of the feature on the path (``o_i = 1``) or not. The leaf's value is then a product game, and the
Shapley value of feature ``i`` for a leaf of value ``v`` is

    v * (o_i - z_i) * integral over s in [0, 1] of prod_{j != i} (z_j (1 - s) + o_j s)

The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature with d/2 nodes is exact. Summing over leaves
and trees gives the ensemble's values (Lundberg et al., 2020, "From local explanations to global understanding with
explainable AI for trees").

A leaf with d path features knows only 2^d kinds of rows, those that pass the same set of features. So the d weights of
each set are tabled once for a block of rows, and a row costs one look-up per leaf. The set is a number with a bit per
feature of the path; it comes from walking down all trees of a block level by level, one comparison per split and row.
Where a table would have many more entries than there are rows, the sets that occur are integrated one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Trees are read, broadcast and added up in groups of about this many nodes (a larger tree is a group of its own):
# some 70 bytes a node.
NODES_PER_PART = 1_000_000
# Nodes of the trees that rows walk down together, rows of a block, and numbers in a temporary array.
NODES_PER_BLOCK = 20_000
ROWS_PER_BLOCK = 2048
CELLS_PER_BLOCK = 2_000_000
# Tables have at most this many sets, and at most this many times the rows of a block.
TABLE_BITS = 12
SETS_PER_ROW = 4


@dataclass(frozen=True)
class Level:
    """Nodes at one depth of some trees: positions of leaves and of splits, and what the splits compare."""

    leaves: np.ndarray
    splits: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    bit: np.ndarray


@dataclass(frozen=True)
class LeafGroup:
    """Leaves with the same number of distinct path features; ``at`` is their place among the leaves of the block."""

    at: np.ndarray
    feature: np.ndarray  # (leaves, d)
    share: np.ndarray
    value: np.ndarray  # (leaves, outputs)


@dataclass(frozen=True)
class Block:
    trees: int
    levels: tuple[Level, ...]
    groups: tuple[LeafGroup, ...]


@dataclass(frozen=True)
class Ensemble:
    n_features: int
    n_outputs: int
    base: np.ndarray
    blocks: tuple[Block, ...]

    @property
    def leaves(self) -> int:
        return sum(len(level.leaves) for b in self.blocks for level in b.levels)


@dataclass(frozen=True)
class Nodes:
    """Nodes of some trees, tree by tree with the root first; children are positions here, -1 for leaves."""

    tree: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # (nodes, outputs)


def load_ensembles(spark: SparkSession, path: str, n_features: int, kind: str) -> Iterator[Ensemble]:
    """Read a saved Spark tree model, a group of trees at a time; base and contributions of the groups add up.

    ``kind``: ``forest_classes`` (class shares averaged over trees),
    ``forest_value`` (predictions averaged) or ``boosted`` (weighted sum).
    """
    data = spark.read.parquet(f"{path}/data")
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
    sizes = sorted((r[0], r[1]) for r in data.groupBy("treeID").count().collect())
    node = ["id", "prediction", "impurityStats", "leftChild", "rightChild"]
    columns = [F.col(f"nodeData.{c}").alias(c) for c in node]
    split = [F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")]
    for first, last in _tree_groups(sizes):
        rows = data.where(F.col("treeID").between(first, last)).select(F.col("treeID").alias("tree"), *columns, *split).toArrow()
        flat = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        stats = flat.pop("impurityStats")
        cells = np.asarray(stats.flatten()).reshape(len(stats), -1)
        numbers = {c: np.nan_to_num(v.to_numpy(zero_copy_only=False)) for c, v in flat.items()}
        trees = np.unique(numbers["tree"])
        scales = {int(t): weights[int(t)] if kind == "boosted" else 1.0 / len(weights) for t in trees}
        yield _ensemble(_nodes(numbers, cells, scales, kind), n_features)


def _tree_groups(sizes: Sequence[tuple[int, int]], most: int | None = None) -> list[tuple[int, int]]:
    """First and last tree of each group, from ``(tree, nodes)`` in order."""
    groups: list[list[int]] = []
    held = 0
    for tree, nodes in sizes:
        if not groups or held + nodes > (most or NODES_PER_PART):
            groups.append([tree, tree])
            held = 0
        groups[-1][1] = tree
        held += nodes
    return [(first, last) for first, last in groups]


def build_ensemble(trees: Sequence[tuple[pd.DataFrame, float]], n_features: int, kind: str) -> Ensemble:
    """The same from frames with Spark's columns of tree nodes, one frame and scale per tree."""
    frames = [nodes.assign(tree=t) for t, (nodes, _) in enumerate(trees)]
    rows = pd.concat(frames)
    numbers = {c: rows[c].to_numpy() for c in ("tree", "id", "prediction", "leftChild", "rightChild")}
    numbers["feature"] = np.array([int(x["featureIndex"]) for x in rows["split"]])
    numbers["threshold"] = np.array([float((list(x["leftCategoriesOrThreshold"]) or [0.0])[0]) for x in rows["split"]])
    cells = np.array([np.asarray(x, dtype=float) for x in rows["impurityStats"]])
    return _ensemble(_nodes(numbers, cells, {t: scale for t, (_, scale) in enumerate(trees)}, kind), n_features)


def _nodes(rows: dict[str, np.ndarray], stats: np.ndarray, scales: dict[int, float], kind: str) -> Nodes:
    order = np.lexsort((rows["id"], rows["tree"]))
    tree, number = rows["tree"][order].astype(np.int64), rows["id"][order].astype(np.int64)
    width = int(number.max()) + 1
    key = tree * width + number

    def child(name: str) -> np.ndarray:
        c = rows[name][order].astype(np.int64)
        return np.where(c < 0, -1, np.searchsorted(key, tree * width + c))

    stats = stats[order]
    scale = np.array([scales[int(t)] for t in tree])
    if kind == "forest_classes":
        cover = stats.sum(axis=1)
        value = stats / cover[:, None] * scale[:, None]
    else:
        cover = stats[:, 0]
        value = (rows["prediction"][order].astype(float) * scale)[:, None]
    return Nodes(tree, child("leftChild"), child("rightChild"), rows["feature"][order].astype(np.int64), rows["threshold"][order].astype(float), cover, value)


def _ensemble(nodes: Nodes, n_features: int) -> Ensemble:
    sizes = list(zip(*(x.tolist() for x in np.unique(nodes.tree, return_counts=True))))
    base, blocks = np.zeros(nodes.value.shape[1]), []
    for first, last in _tree_groups(sizes, NODES_PER_BLOCK):
        block, part = _block(nodes, np.flatnonzero((nodes.tree >= first) & (nodes.tree <= last)))
        base += part
        blocks.append(block)
    return Ensemble(n_features, nodes.value.shape[1], base, tuple(blocks))


def _block(nodes: Nodes, members: np.ndarray) -> tuple[Block, np.ndarray]:
    """Some trees by levels, and their expected value. Each path keeps its features in order of appearance."""
    roots = members[np.r_[True, np.diff(nodes.tree[members]) != 0]]
    at, count = roots, np.zeros(len(roots), np.int64)
    feature, share = np.full((len(roots), 0), -1, np.int64), np.ones((len(roots), 0))
    levels, ended, n_leaves = [], [], 0
    while len(at):
        is_leaf = nodes.left[at] < 0
        leaves, splits = np.flatnonzero(is_leaf), np.flatnonzero(~is_leaf)
        ended += [(n_leaves + k, d, feature[i, :d], share[i, :d], nodes.value[at[i]]) for k, (i, d) in enumerate(zip(leaves, count[leaves].tolist()))]
        n_leaves += len(leaves)
        here = at[splits]
        f = nodes.feature[here]
        feature, share, count = feature[splits], share[splits], count[splits]
        same = feature == f[:, None]
        known = same.any(axis=1)
        slot = np.where(known, same.argmax(axis=1) if same.shape[1] else 0, count)
        if len(slot) and slot.max() >= feature.shape[1]:
            feature = np.pad(feature, ((0, 0), (0, 1)), constant_values=-1)
            share = np.pad(share, ((0, 0), (0, 1)), constant_values=1.0)
        rows = np.arange(len(here))
        feature[rows, slot] = f
        count = np.where(known, count, count + 1)
        shares = []
        for child in (nodes.left[here], nodes.right[here]):
            z = share.copy()
            z[rows, slot] *= nodes.cover[child] / nodes.cover[here]
            shares.append(z)
        levels.append(Level(leaves, splits, f, nodes.threshold[here], (1 << slot).astype(np.uint32)))
        at = np.r_[nodes.left[here], nodes.right[here]]
        feature, share, count = np.r_[feature, feature], np.concatenate(shares), np.r_[count, count]
    base = sum(value * np.prod(z) for _, _, _, z, value in ended)
    groups = []
    for d in sorted({d for _, d, *_ in ended if d}):
        some = [x for x in ended if x[1] == d]
        groups.append(LeafGroup(np.array([x[0] for x in some]), np.array([x[2] for x in some], np.int32), np.array([x[3] for x in some]), np.array([x[4] for x in some])))
    return Block(len(roots), tuple(levels), tuple(groups)), base


def shap_values(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """``(rows, outputs, features)``."""
    out = np.zeros((len(x), ensemble.n_outputs, ensemble.n_features))
    for start in range(0, len(x), ROWS_PER_BLOCK):
        part = slice(start, start + ROWS_PER_BLOCK)
        columns = np.ascontiguousarray(x[part].T)
        for block in ensemble.blocks:
            sets = _passed(block, columns)
            for g in block.groups:
                _add_leaves(out[part], sets[g.at], g)
    return out


def _passed(block: Block, columns: np.ndarray) -> np.ndarray:
    """(leaves, rows): the set of path features whose splits a row passes, bit by bit in order of appearance."""
    sets = np.full((block.trees, columns.shape[1]), 0xFFFFFFFF, np.uint32)
    ended = []
    for level in block.levels:
        ended.append(sets[level.leaves])
        left = columns[level.feature] <= level.threshold[:, None]
        sets = sets[level.splits]
        without = sets & ~level.bit[:, None]
        sets = np.concatenate([np.where(left, sets, without), np.where(left, without, sets)])
    return np.concatenate(ended)


def _add_leaves(out: np.ndarray, sets: np.ndarray, g: LeafGroup) -> None:
    n, (leaves, d), outputs = len(out), g.feature.shape, g.value.shape[1]
    tabled = d <= TABLE_BITS and 1 << d <= SETS_PER_ROW * n
    width = outputs * out.shape[2]
    step = max(1, CELLS_PER_BLOCK // (d * max(n, 1 << d if tabled else n, width)))
    for first in range(0, leaves, step):
        part = slice(first, first + step)
        which = (sets[part] & np.uint32((1 << d) - 1)).T  # (rows, leaves)
        if tabled:
            table = _subset_table(g.share[part])
            weights = table.reshape(-1, d)[which + (np.arange(which.shape[1]) << d)].reshape(n, -1)
            _scatter(out, weights, g.feature[part].ravel(), np.repeat(g.value[part], d, axis=0))
        else:
            for j, weights in enumerate(_subset_weights(g.share[part], which)):
                _scatter(out, weights, g.feature[part, j], g.value[part])


def _scatter(out: np.ndarray, weights: np.ndarray, feature: np.ndarray, value: np.ndarray) -> None:
    """Adds weights (rows, n) times values (n, outputs) to the features (n) they belong to."""
    names, place = np.unique(feature, return_inverse=True)
    for k in range(out.shape[1]):
        to = np.zeros((len(feature), len(names)))
        to[np.arange(len(feature)), place.ravel()] = value[:, k]
        out[:, k, names] += weights @ to


def _factors(share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quadrature weights, and each feature's factor at each node without and with the feature: (leaves, d, nodes)."""
    nodes, weights = np.polynomial.legendre.leggauss((share.shape[1] + 1) // 2)
    s = (nodes + 1) / 2
    without = share[:, :, None] * (1 - s)
    return weights / 2, without, without + s


def _subset_table(share: np.ndarray) -> np.ndarray:
    """(leaves, 2^d, d): the weight of every feature for every set of passed features."""
    leaves, d = share.shape
    w, without, with_ = _factors(share)
    product = np.ones((leaves, 1, len(w)))
    for j in range(d):
        product = np.concatenate([product * without[:, None, j], product * with_[:, None, j]], axis=1)
    inside = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1
    passed = product @ (w / with_ * (1 - share)[:, :, None]).transpose(0, 2, 1)
    failed = product @ (w / without * share[:, :, None]).transpose(0, 2, 1)
    return np.where(inside, passed, -failed)


def _subset_weights(share: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """(rows, leaves) for each path feature: its weight for the sets that occur."""
    d = share.shape[1]
    w, without, with_ = _factors(share)
    passed = [(which >> np.uint32(j)) & np.uint32(1) == 1 for j in range(d)]
    totals = [np.zeros(which.shape) for _ in range(d)]
    for q in range(len(w)):
        factors = [np.where(passed[j], with_[:, j, q], without[:, j, q]) for j in range(d)]
        product = np.full(which.shape, w[q])
        for f in factors:
            product *= f
        for total, f in zip(totals, factors):
            total += product / f
    for j in range(d):
        yield totals[j] * (passed[j] - share[:, j])


def add_tree_shap(df: DataFrame, ensemble: Ensemble, features: Column, output: str = "shap") -> DataFrame:
    """``df`` plus an array per output of one contribution per feature.

    Row-local; only the feature arrays travel to Python, other columns stay in the JVM.
    """
    model = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def attribute(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        phi = shap_values(model.value, np.stack(rows.to_numpy()).astype(float))
        return pd.Series(phi.tolist())

    return df.withColumn(output, attribute(features))
