"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    from tablewright.catalog import features, lifecycle, modelling, preparation, profiling, serving, training

    out: dict[str, Query] = {}
    for module in (profiling, preparation, features, modelling, serving, training, lifecycle):
        out.update(module.QUERIES)
    return out


def all_sql() -> dict[str, str]:
    from tablewright.catalog import features, lifecycle, modelling, preparation, profiling, serving, training

    out: dict[str, str] = {}
    for module in (profiling, preparation, features, modelling, serving, training, lifecycle):
        out.update(module.SQL)
    return out
