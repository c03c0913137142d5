"""Left lookup of a value table: broadcast behind a size check, hot/cold join beyond it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import column
from tablewright.functions.values import without_nan

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 48
# A value that makes up at least 1/HOT_SHARE of all rows is "hot"; there can be
# no more than HOT_SHARE of them, whatever the data.
HOT_SHARE = 1000


def mapping_bytes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Estimated size of the per-value table of each column, from one scan.

    A distinct-count sketch with a 10 % allowance times the longest value.
    """
    if not columns:
        return {}
    aggs = []
    for i, n in enumerate(columns):
        c = without_nan(df, n)
        aggs.append(F.approx_count_distinct(c, 0.02).alias(f"d{i}"))
        aggs.append(F.max(F.octet_length(c.cast("string"))).alias(f"l{i}"))
    r = df.agg(*aggs).first()
    return {n: int(r[f"d{i}"] * 1.1 + 1) * ((r[f"l{i}"] or 0) + ROW_OVERHEAD_BYTES) for i, n in enumerate(columns)}


def left_lookup(
    df: DataFrame,
    name: str,
    mapping: DataFrame,
    payload: Sequence[str],
    size_bytes: int,
    count: str,
    total_rows: int | None = None,
    share: int = 1,
) -> DataFrame:
    """Add ``payload`` columns of ``mapping`` (keyed by ``key``) for the values of column ``name``.

    Small mappings are broadcast; ``share`` lookups of one plan divide the
    budget. Of a large one only the hot values are (at most ``HOT_SHARE`` rows,
    found through their ``count``). All rows meet the mapping in one shuffled
    join; those that are answered already, and those without a value, travel
    under the number of their partition instead of their value, so that no
    value holds more than a thousandth of the rows of a task.
    """
    keyed = df.withColumn("_key", without_nan(df, name))
    if size_bytes * share <= BROADCAST_BYTES:
        small = mapping.select(F.col("key").alias("_key"), *payload)
        return keyed.join(F.broadcast(small), "_key", "left").drop("_key")
    if total_rows is None:
        total_rows = mapping.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]

    values = F.struct(*[F.col(p) for p in payload])
    hot = mapping.where(F.col(count) * HOT_SHARE >= F.lit(total_rows)).select(
        F.col("key").alias("_key"), values.alias("_hot")
    )
    cold = mapping.select(F.col("key").alias("_key"), F.lit(-1).alias("_salt"), values.alias("_cold"))
    settled = F.col("_hot").isNotNull() | F.col("_key").isNull()
    spread = keyed.join(F.broadcast(hot), "_key", "left").select(
        *[column(c) for c in df.columns],
        "_hot",
        F.when(~settled, F.col("_key")).alias("_key"),
        F.when(settled, F.spark_partition_id()).otherwise(-1).alias("_salt"),
    )
    found = F.coalesce("_hot", "_cold")
    return spread.join(cold, ["_key", "_salt"], "left").select(
        *[column(c) for c in df.columns], *[found.getField(p).alias(p) for p in payload]
    )
