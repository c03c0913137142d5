"""Training rows as a table of bins, and trees grown on it in one task.

A tree learner with candidate cuts knows a row only by the bin of each feature. Rows that agree in all bins and in the label
are one row of the table with their number, which is exact: a bootstrap weight of m such rows is Poisson(m), and a sum over
them is m times one of them. A bin is a byte, so millions of training rows take some tens of megabytes and a tree needs no
pass over the cluster for each of its levels; trees of a forest, and models of a suite, fill the cores. Beyond ``MOST_CELLS``
the table is not made and Spark's own learners do the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training rows from which the table is made, and the most cells (rows times features, and eight for the label) of a table.
LEAST_ROWS, MOST_CELLS = 10_000, 100_000_000
#: Cuts come from about so many rows, as Spark's learners take them.
ROWS_FOR_CUTS = 10_000


@dataclass(frozen=True)
class Bins:
    """``bins[f, i]`` of feature f and row i, its cuts (a value up to cut b is in bin b or below), label and number of rows."""

    bins: np.ndarray
    cuts: tuple[np.ndarray, ...]
    label: np.ndarray
    count: np.ndarray


@dataclass(frozen=True)
class Tree:
    """Nodes level by level, the root first: feature (-1 in leaves), last bin of the left side, left child (the right one is
    next to it), and the sums of the node's rows (of each class, or weight, weighted label and its square)."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    stats: np.ndarray


def cuts_of(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Candidate cuts of a feature: between all values if they are few, else at equal shares of the rows, as in Spark."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    zeros = len(values) - counts.sum()
    if zeros:
        place = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, place, 0.0), np.insert(counts, place, zeros)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < max_bins:
        return middle
    stride, so_far = len(values) / max_bins, np.cumsum(counts)
    cuts, target = [], stride
    for i in range(1, len(found)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            cuts.append(middle[i - 1])
            target += stride
    return np.array(cuts[: max_bins - 1])


def bin_table(train: DataFrame, rows: int, n_features: int, max_bins: int, seed: int) -> Bins | None:
    """The table of ``train`` (features, label), in an order of its own so that equal rows give equal tables; None if it is too large."""
    if max_bins > 256:
        return None
    some = train.select(vector_to_array("features").alias("x"))
    wanted = max(max_bins * max_bins, ROWS_FOR_CUTS)
    some = some.sample(min(1.0, wanted / rows), seed) if rows > wanted else some
    x = np.array([r["x"] for r in some.collect()], dtype=float).reshape(-1, n_features)
    cuts = tuple(cuts_of(x[:, f], max_bins) for f in range(n_features))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_features)
            keys = np.stack([np.searchsorted(cuts[f], flat[:, f]) for f in range(n_features)], axis=1).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(n_features), batch.num_rows, [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column(1)], names=["key", "label"])

    named = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")).mapInArrow(binned, "key binary, label double")
    table = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        if table.count() * (n_features + 8) > MOST_CELLS:
            return None
        got = table.toArrow()
    finally:
        table.unpersist()
    keys = np.frombuffer(b"".join(got.column("key").to_pylist()), np.uint8).reshape(-1, n_features)
    label, count = got.column("label").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((label, *keys.T))
    return Bins(np.ascontiguousarray(keys[order].T), cuts, label[order], count[order].astype(float))


def _score(s: np.ndarray, gini: bool) -> np.ndarray:
    """What a side of a split keeps: the larger the sum of both sides, the larger the gain."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((w := s.sum(axis=0)) > 0, (s * s).sum(axis=0) / w, 0.0) if gini else np.where(s[0] > 0, s[1] * s[1] / s[0], 0.0)


def _weight(s: np.ndarray, gini: bool) -> np.ndarray:
    return s.sum(axis=0) if gini else s[0]


def _dense(key: np.ndarray, stats: np.ndarray, total: np.ndarray, width: int, gini: bool) -> tuple[np.ndarray, np.ndarray]:
    m = total.shape[1]
    left = np.stack([np.bincount(key, s, m * width).reshape(m, width)[:, :-1].cumsum(axis=1) for s in stats])
    right = total[:, :, None] - left
    kept = _score(left, gini) + _score(right, gini)
    kept[(_weight(left, gini) < TINY) | (_weight(right, gini) < TINY)] = -np.inf
    at = kept.argmax(axis=1)
    return kept[np.arange(m), at], at


def _sparse(key: np.ndarray, stats: np.ndarray, total: np.ndarray, width: int, gini: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same where nodes have few rows: only bins that occur are looked at."""
    packed = (key.astype(np.int64) << 32) | np.arange(len(key))
    packed.sort()
    of, key = packed & 0xFFFFFFFF, packed >> 32
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    node, bin = key[first] // width, key[first] % width
    sums = np.add.reduceat(stats[:, of], first, axis=1)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    left = sums.cumsum(axis=1)
    left -= (left[:, start] - sums[:, start])[:, node]
    right = total[:, node] - left
    kept = _score(left, gini) + _score(right, gini)
    kept[np.r_[start[1:] - 1, len(node) - 1]] = -np.inf  # nothing is right of a node's last bin
    most = np.maximum.reduceat(kept, start)
    best = np.flatnonzero(kept == most[node])
    best = best[np.r_[True, node[best][1:] != node[best][:-1]]]
    return most, bin[best]


#: Sums below this are empty, and gains below this share of what a node keeps are rounding.
TINY = 1e-9


def grow(table: Bins, stats: np.ndarray, gini: bool, depth: int, per_node: int, rng: np.random.Generator | None) -> tuple[Tree, np.ndarray]:
    """A tree on rows with ``stats`` (sums, rows), and the leaf of every row (of weight 0 too).

    A node splits at the largest gain of ``per_node`` features drawn for it, as long as there is one and it is not ``depth`` deep.
    """
    n_features, n = table.bins.shape
    widths = [len(c) + 1 for c in table.cuts]
    flat = table.bins.ravel()
    rows = np.arange(n) if rng is None else np.flatnonzero(_weight(stats, gini) > 0)
    sums, at = stats[:, rows], np.zeros(len(rows), np.int64)
    leaf = np.zeros(n, np.int64)
    total = sums.sum(axis=1)[:, None]
    parts: list[tuple[np.ndarray, ...]] = []
    ids, made = np.zeros(1, np.int64), 1
    for d in range(depth + 1):
        m = total.shape[1]
        feature, cut, left = np.full(m, -1, np.int16), np.zeros(m, np.int16), np.full(m, -1, np.int32)
        parts.append((feature, cut, left, total))
        leaf[rows] = ids[at]
        if gini:
            mixed = total.max(axis=0) < total.sum(axis=0)
        else:
            mixed = total[2] - _score(total, False) > 1e-12 * np.abs(total[2])
        if d == depth or not mixed.any():
            break
        keep = mixed[at]
        rows, sums, at = rows[keep], sums[:, keep], (np.cumsum(mixed) - 1)[at[keep]]
        todo = np.flatnonzero(mixed)
        now = np.ascontiguousarray(total[:, todo])
        m = len(todo)
        some = per_node < n_features
        if some:
            drawn = np.argpartition(rng.random((m, n_features)), per_node - 1, axis=1)[:, :per_node]
        searched = sums if gini else sums[:2]
        best, best_f, best_b = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for j in range(per_node if some else n_features):
            width = max(widths) if some else widths[j]
            if width < 2:
                continue
            b = flat[drawn[:, j][at] * n + rows] if some else table.bins[j][rows]
            search = _dense if m * width <= 2 * len(rows) else _sparse
            kept, bins = search(at * width + b, searched, now[: len(searched)], width, gini)
            better = kept > best
            best[better], best_b[better] = kept[better], bins[better]
            best_f[better] = drawn[better, j] if some else j
        had = _score(now, gini)
        ok = best - had > 1e-12 * np.abs(had)
        if not ok.any():
            break
        goes = todo[ok]
        feature[goes], cut[goes], left[goes] = best_f[ok], best_b[ok], made + 2 * np.arange(len(goes))
        keep = ok[at]
        rows, sums, at = rows[keep], sums[:, keep], (np.cumsum(ok) - 1)[at[keep]]
        at = 2 * at + (flat[best_f[ok][at] * n + rows] > best_b[ok][at])
        total = np.stack([np.bincount(at, s, 2 * len(goes)) for s in sums])
        ids = made + np.arange(2 * len(goes))
        made += 2 * len(goes)
    feature, cut, left, stats = (np.concatenate(p, axis=-1) for p in zip(*parts))
    return Tree(feature, cut, left, stats), leaf


def pruned(tree: Tree) -> Tree:
    """Without splits between two leaves of the same class, as Spark leaves them out."""
    feature, left = tree.feature.copy(), tree.left.copy()
    told = tree.stats.argmax(axis=0)
    inner = np.flatnonzero(left >= 0)
    while True:
        a = left[inner]
        same = (left[a] < 0) & (left[a + 1] < 0) & (told[a] == told[a + 1])
        if not same.any():
            break
        gone = inner[same]
        feature[gone], left[gone] = -1, -1
        inner = inner[~same]
    kept = np.zeros(len(left), bool)
    kept[0] = True
    kept[left[inner]] = kept[left[inner] + 1] = True
    place = np.cumsum(kept) - 1
    return Tree(feature[kept], tree.bin[kept], np.where(left >= 0, place[left], -1)[kept].astype(np.int32), tree.stats[:, kept])
