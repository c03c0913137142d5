"""Pearson correlation over pair-wise complete rows, from co-moments that are merged task by task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import numeric_columns
from tablewright.functions.values import as_double

_SCHEMA = "col_a string, col_b string, corr double"


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_a, col_b, corr)`` for a before b; NULL where a side is constant or pairs are too few."""
    names = list(columns if columns is not None else numeric_columns(df))
    return _listed(df, names, list(combinations(range(len(names)), 2)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full matrix in long form, both triangles and the diagonal: a column correlates with itself at 1 unless it is
    constant or too short. Empty for fewer than two columns."""
    names = list(columns if columns is not None else numeric_columns(df))
    k = len(names)
    return _listed(df, names, [(i, j) for i in range(k) for j in range(k)] if k > 1 else [])


def _listed(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], _SCHEMA)
    r = _coefficients(df, names)
    cell = lambda i, j: None if np.isnan(r[i, j]) else 1.0 if i == j else float(r[i, j])
    return spark.createDataFrame([(names[i], names[j], cell(i, j)) for i, j in pairs], _SCHEMA)


@dataclass
class CoMoments:
    """Count, means, spread and co-moment of every ordered pair of columns, over the rows where both are present.

    ``mean[i, j]`` and ``spread[i, j]`` (sum of squared distances from that mean) belong to column i.
    """

    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    co: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """State of some rows (rows, columns), NaN where missing."""
        present = ~np.isnan(x)
        m = present.astype(float)
        n = m.T @ m
        # distances from a value of the column keep the digits of columns far from zero, and are exact zeros if it is constant
        base = x[np.argmax(present, axis=0), np.arange(x.shape[1])]
        base = np.where(np.isnan(base), 0.0, base)
        d = np.where(present, x - base, 0.0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            mean = np.where(n > 0, (d.T @ m) / n, 0.0)
            square = (d * d).T @ m
            spread = square - n * mean * mean
            co = d.T @ d - n * mean * mean.T
            # what is left of a constant side by rounding is no spread
            spread = np.where(spread <= 1e-14 * square, 0.0, spread)
        return cls(n, mean + base[:, None], spread, co)

    def merged(self, other: CoMoments) -> CoMoments:
        """State of the rows of both (Chan, Golub and LeVeque's update, for all pairs at once)."""
        n = self.n + other.n
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            share = np.where(n > 0, other.n / n, 0.0)
            # no rows on one side: the other side's mean, not a mix with 0
            gap = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
            mean = np.where(self.n > 0, self.mean + gap * share, other.mean)
            weight = self.n * share
            return CoMoments(n, mean, self.spread + other.spread + gap * gap * weight, self.co + other.co + gap * gap.T * weight)

    def to_bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.spread, self.co]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, k: int) -> CoMoments:
        return cls(*np.frombuffer(data).reshape(4, k, k))


def _merged(states: Iterable[CoMoments]) -> CoMoments | None:
    out = None
    for state in states:
        out = state if out is None else out.merged(state)
    return out


def co_moments(df: DataFrame, columns: Sequence[str]) -> CoMoments | None:
    """State of all rows, None without any.

    Every task turns its rows into one k by k state by matrix products, so the cost of a row is that of k*k multiplications
    and no row is multiplied by the number of pairs. States are merged in groups, as many as the square root of the session's
    shuffle partitions, and those of the groups on the driver.
    """
    k = len(columns)
    data = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(columns)])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at most some megabytes of distances at a time
        step = max(1, 4_000_000 // k)
        parts = (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))
        rows = (np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in p.columns], axis=1) for p in parts)
        state = _merged(CoMoments.of(x) for x in rows)
        if state is not None:
            yield _row(TaskContext.get().partitionId(), state)

    def merge(table: pa.Table) -> pa.Table:
        state = _merged(CoMoments.from_bytes(s.as_py(), k) for s in table.column("state"))
        return pa.Table.from_batches([_row(0, state)])

    def _row(part: int, state: CoMoments) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.to_bytes()], pa.binary())], names=["part", "state"])

    schema = "part int, state binary"
    groups = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per_task = data.mapInArrow(states, schema).withColumn("part", F.col("part") % max(1, groups))
    rows = per_task.groupBy("part").applyInArrow(merge, schema).collect()
    return _merged(CoMoments.from_bytes(bytes(r["state"]), k) for r in rows)


def _coefficients(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """k by k coefficients, NaN where a side is constant or pairs are too few."""
    state = co_moments(df, names)
    if state is None:
        return np.full((len(names), len(names)), np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = state.co / (np.sqrt(state.spread) * np.sqrt(state.spread.T))
    return np.where(np.isfinite(r), np.clip(r, -1.0, 1.0), np.nan)
