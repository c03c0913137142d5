"""Running totals over a global order, without a single-task window.

The input holds one row per (group, order value), so hot values are already
one row. Small tables use a plain window. Larger ones are range-partitioned,
written to the checkpoint folder (range bounds are sampled, so the partition a
row fell into must be fixed before it is used twice), and each partition's
running total is shifted by the sum of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialise

WINDOW_ROWS = 1_000_000


def running_totals(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    rows_hint: int | None = None,
) -> DataFrame:
    """Inclusive running sums per group, in ascending order.

    ``rows_hint`` is an upper bound or estimate of the number of rows; None
    means unknown and takes the distributed path.
    """
    if rows_hint is not None and rows_hint <= WINDOW_ROWS:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return table.select("*", *[F.sum(c).over(w).alias(n) for n, c in totals.items()])

    ranged = table.repartitionByRange(*[F.col(n) for n in [*group, *order]])
    fixed = materialise(
        ranged.select("*", F.spark_partition_id().alias("_part"), *[c.alias(f"_{n}") for n, c in totals.items()])
    )
    # One row per (group, partition a group touches): at most groups + partitions rows.
    per_part = fixed.groupBy(*group, "_part").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in totals])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *group, "_part", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in totals]
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = fixed.select("*", *[F.sum(f"_{n}").over(inside).alias(f"_run_{n}") for n in totals])
    joined = local.join(offsets, [*group, "_part"], "left")
    return joined.select(
        *table.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in totals]
    )
