"""Scored columns from class probabilities, and confidence summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scores import argmax_index, decode_label


def add_decision(
    df: DataFrame,
    scores: Column,
    labels: Sequence[str] | None,
    prediction: str = "prediction",
    probability: str = "probability",
) -> DataFrame:
    """Label of the largest score (the first on a tie) and that score."""
    return df.select("*", decode_label(argmax_index(scores), labels).alias(prediction), F.array_max(scores).alias(probability))


def mean_confidence(scored: DataFrame, probability: str = "probability") -> DataFrame:
    return scored.agg(F.avg(probability).alias("avg_confidence"))
