"""Repeatable row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.constants import SAMPLE_ROWS, SEED
from tablewright.functions.kinds import column
from tablewright.functions.values import portable

# Copies of one row that are numbered by one task.
COPIES_PER_BLOCK = 100_000


def seeded_digest(key: Column, seed: int = SEED) -> Column:
    """Text digest of a key and a seed: a random-looking yet repeatable order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def sample_rows(df: DataFrame, key: Sequence[str] | None = None, size: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Up to ``size`` rows in hash order of their key, printed in key order.

    Each task keeps only its best ``size`` rows. Without a key equal rows are
    counted, and every copy has a place of its own by the hash of row and copy
    number, so a content comes up as often as its share of the table.
    """
    if key:
        picker = seeded_digest(F.concat_ws("|", *[column(k).cast("string") for k in key]), seed)
        out = df.orderBy(picker).limit(size).orderBy(*[column(k) for k in key])
    else:
        out = _sample_of_copies(df, size, seed)
    return portable(out)


def _sample_of_copies(df: DataFrame, size: int, seed: int) -> DataFrame:
    """Bottom-k over (row, copy number); copies are numbered block by block, away from the task that counted them."""
    columns = [column(n) for n in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    last = F.floor((F.col("_n") - 1) / COPIES_PER_BLOCK)
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(F.xxhash64("_b", *columns))
    copies = F.least(F.lit(COPIES_PER_BLOCK), F.col("_n") - F.col("_b") * COPIES_PER_BLOCK).cast("int")
    numbered = blocks.withColumn("_c", F.explode(F.sequence(F.lit(1), copies)))
    order = F.xxhash64(F.lit(seed), "_b", "_c", *columns)
    return numbered.orderBy(order, "_b", "_c", *columns).limit(size).select(*columns)
