"""Expressions over arrays of class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax_index(scores: Column) -> Column:
    """Zero-based position of the largest score; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def decode_label(index: Column, labels: Sequence[str] | None) -> Column:
    """Class index to its label; without labels the index itself as text."""
    if not labels:
        return index.cast("string")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index.cast("int") + 1)


def normalised_sum(values: Column) -> Column:
    """Array scaled to sum to one."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def softmax(margins: Column) -> Column:
    """Shares of an array of margins; the largest margin is taken off first, so none overflows."""
    return normalised_sum(F.transform(margins, lambda x: F.exp(x - F.array_max(margins))))
