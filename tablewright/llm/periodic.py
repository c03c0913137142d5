"""Periodic runs of words: sparse diagonal dynamic programming over earlier occurrences.

A cell is a pair of a word and an earlier occurrence of it; the distance of the two, the lag, is its diagonal. The match
length of a cell is one more than that of the cell before it on the same diagonal, and 0 where there is none, so a
diagonal that ends after enough matches is a run: a stretch of words that equal the words one period before.

Only cells that can carry a run are visited. Of all lags up to ``m / 2`` and from ``m / 3`` on, a word looks at its latest
earlier occurrence with the same ``m - 1`` words before it: in a run of smallest period ``q`` and length ``4 q`` or more,
with ``2 q <= m <= 3 q``, no nearer place has the same m words (the m words would have two periods of a sum of at most m,
so a period smaller than q), hence this occurrence lies on the diagonal ``q``, and the diagonal goes on for as long as the
run does. There is thus one cell per word and level of context, levels grow by half, and texts of one repeated word cost
no more than others. Contexts are numbered exactly (a context of 2k words is a pair of contexts of k words), and a context
that occurs once in its text is dropped together with all longer ones, which leaves few words of ordinary prose.

Words are separated by the white space of ASCII. NULL, empty and blank texts have no words and no runs. Repeated rows are
treated like others, an empty table gives an empty result, and a text of any length is treated whole in one task. Input
columns keep their names and values; a new column whose name is taken gets underscores at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import append_columns

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class RunOptions:
    """A run has ``min_length`` words and ``min_exponent`` periods at least; ``min_exponent`` of 4 or more."""

    min_length: int = 6
    min_exponent: int = 4

    def __post_init__(self):
        if self.min_exponent < 4:
            raise ValueError("min_exponent is 4 at least: shorter runs are not on one diagonal of each level")


def levels(longest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(words of context, smallest lag, largest lag): every lag up to ``longest / exponent`` is in one level."""
    low = 1
    while low * exponent <= longest:
        words = 3 * low if low > 1 else 2
        yield words, low, words // 2
        low = words // 2 + 1


class Contexts:
    """Numbers for the contexts of 1, 2, 4, ... words that end at a position; -1 for a context that occurs once."""

    def __init__(self, words: np.ndarray):
        self.ids = [_numbered(np.arange(len(words)), words, len(words))]

    def of(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, key): where the context of ``m`` words may occur twice; equal contexts have equal keys."""
        k = m.bit_length() - 1
        while len(self.ids) <= k:
            half = 1 << (len(self.ids) - 1)
            at, key = self._pairs(len(self.ids) - 1, half)
            self.ids.append(_numbered(at, key, len(self.ids[0])))
        if m == 1 << k:
            at = np.flatnonzero(self.ids[k] >= 0)
            return at, self.ids[k][at]
        return self._pairs(k, m - (1 << k))

    def _pairs(self, k: int, back: int) -> tuple[np.ndarray, np.ndarray]:
        now = self.ids[k]
        at = np.flatnonzero(now[back:] >= 0) + back
        at = at[now[at - back] >= 0]
        return at, now[at - back].astype(np.int64) * len(now) + now[at]


def _numbered(at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -1, np.int64)
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count[number] > 1
    out[at[twice]] = number[twice]
    return out


def find(words: np.ndarray, longest: int, options: RunOptions) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start, then period.

    Texts laid end to end need word numbers that differ from text to text; ``longest`` is the length of the longest.
    """
    contexts, found = Contexts(words), []
    for m, low, high in levels(longest, options.min_exponent):
        at, key = contexts.of(m)
        if not len(at):
            break
        order = np.argsort(key, kind="stable")
        lag = np.zeros(len(at), np.int64)
        same = key[order[1:]] == key[order[:-1]]
        lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
        cell = (lag >= low) & (lag <= high)
        at, lag = at[cell], lag[cell]
        if not len(at):
            continue
        # a cell continues the diagonal of the cell before it, or starts one
        starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])])
        ends = np.r_[starts[1:], len(at)] - 1
        period = lag[starts]
        first = at[starts] - (m - 1) - period
        length = at[ends] - first + 1
        long = length >= np.maximum(options.min_length, options.min_exponent * period)
        found.append(np.stack([first[long], length[long], period[long]], axis=1))
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, first word of each text and the number of words at the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    real = pc.not_equal(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty ones
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return words.filter(real), before[bounds]


def _runs_of(texts: pa.Array, options: RunOptions) -> tuple[pa.Array, pa.Array]:
    words, bounds = _split(texts)
    n, sizes = len(words), np.diff(bounds)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find(text_of * (n + 1) + numbers, int(sizes.max(initial=0)), options)
    # words behind the first period of a run go
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(marks)[:n] == 0
    left = np.r_[0, np.cumsum(kept)][bounds].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(kept))), " ")
    mine = text_of[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    runs[:, 0] -= bounds[mine]
    rows = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(_RUN))
    offsets = np.searchsorted(mine, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), rows), collapsed


def find_runs(docs: DataFrame, options: RunOptions | None = None, text_col="text", runs_col="runs", collapsed_col="collapsed") -> DataFrame:
    """``docs`` with ``runs_col`` (start, length, period: word numbers from 0, by start, then period) and ``collapsed_col``:
    the words that no run has behind its first period, joined by one space ('' without words). No shuffle."""
    o = options or RunOptions()

    fields = f"{runs_col} array<struct<start:long,length:long,period:long>>, {collapsed_col} string"
    return append_columns(docs, fields, lambda batch: list(_runs_of(batch.column(text_col), o)), slice_by=text_col)


def longest_run(runs: str | Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); NULL without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period")))
