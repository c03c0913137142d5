"""Repeatable train/test split as a row predicate.

Rows are ordered by a hash of their key and the first ones form the test
part. Instead of sorting, the hash at which a class has given its share is
found by counting hash prefixes, so the split itself is a comparison with one
literal per class: no shuffle, no window, and either side can be recomputed
from the source at any time.

Without a unique key the row at that hash may have copies, of which only some
belong to the test part. They are counted, and the counted row is written out
as often as each side needs it, so the sizes are exact and no copies meet in
one task. All other rows still only meet the comparison.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.constants import SEED, TARGET_MAX_DISTINCT, TEST_SIZE
from tablewright.functions.kinds import column
from tablewright.functions.values import without_nan
from tablewright.operators.sampling import seeded_digest
from tablewright.operators.target import Target

HASH_BITS = 60
PREFIX_BITS = 15
# Copies of one row that are written out by one task.
COPIES_PER_BLOCK = 100_000
# Rows sharing a hash prefix are ranked once at most this many remain.
RANK_ROWS = 200_000


def split_hash(df: DataFrame, key: Sequence[str] | None, seed: int = SEED) -> Column:
    """A 60-bit number from the digest of the row key (of the whole row without a key)."""
    if key:
        text = F.concat_ws("|", *[column(k).cast("string") for k in key])
    else:
        mask = F.concat(*[F.when(column(n).isNull(), "1").otherwise("0") for n in df.columns])
        text = F.xxhash64(mask, *[column(n) for n in df.columns]).cast("string")
    return F.conv(F.substring(seeded_digest(text, seed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Split:
    """The fitted split: thresholds per class, or one for all rows."""

    target: str
    key: tuple[str, ...] | None
    seed: int
    stratified: bool
    thresholds: tuple[tuple[object, int], ...]
    train_rows: int
    test_rows: int
    dropped_rows: int
    test_size: float
    # of the rows at a threshold hash, those that are test rows; only where they are not all
    cut: tuple[tuple[object, int], ...] = ()

    def is_test(self, df: DataFrame) -> Column:
        h = split_hash(df, self.key, self.seed)
        if not self.stratified:
            return h <= F.lit(self.thresholds[0][1])
        label = without_nan(df, self.target)
        limit = None
        for value, t in self.thresholds:
            hit = label == F.lit(value)
            limit = F.when(hit, F.lit(t)) if limit is None else limit.when(hit, F.lit(t))
        return h <= limit

    def mark(self, df: DataFrame, name: str = "is_test") -> DataFrame:
        """All rows with a known target and the side they fall on."""
        known = df.where(without_nan(df, self.target).isNotNull())
        if not self.cut:
            return known.withColumn(name, self.is_test(df))
        at = self._at_cut(df)
        return known.where(~at).withColumn(name, self.is_test(df)).unionByName(self._copies(known.where(at), name))

    def _at_cut(self, df: DataFrame) -> Column:
        """Whether a row has the threshold hash of a class whose copies are divided."""
        h, label, limits = split_hash(df, self.key, self.seed), without_nan(df, self.target), dict(self.thresholds)
        hit = F.lit(False)
        for value, _ in self.cut:
            here = h == F.lit(limits[value])
            hit = hit | (here if value is None else here & (label == F.lit(value)))
        return F.coalesce(hit, F.lit(False))

    def _copies(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows at a threshold, equal ones counted first and written out again with their side."""
        label = without_nan(rows, self.target)
        taken = F.lit(self.cut[0][1]) if not self.stratified else None
        for value, n in self.cut if self.stratified else ():
            taken = F.when(label == F.lit(value), F.lit(n)) if taken is None else taken.when(label == F.lit(value), F.lit(n))
        columns = list(rows.columns)
        found = rows.withColumn("_take", taken.cast("bigint")).groupBy(*[column(c) for c in [*columns, "_take"]]).agg(F.count(F.lit(1)).alias("_n"))
        # different rows with one 60-bit hash are rare; they are divided in an order of their own
        order = Window.partitionBy("_take").orderBy(F.xxhash64(F.lit(self.seed), *[column(c) for c in columns]))
        before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.withColumn("_t", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_take") - before)))
        sides = F.array(F.struct(F.lit(True).alias("side"), F.col("_t").alias("n")), F.struct(F.lit(False).alias("side"), (F.col("_n") - F.col("_t")).alias("n")))
        # in blocks, which are dealt out before they are written out
        blocks = found.select(*[column(c) for c in columns], F.inline(sides)).where("n > 0")
        last = F.floor((F.col("n") - 1) / COPIES_PER_BLOCK)
        blocks = blocks.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("_b", "side")
        size = F.least(F.lit(COPIES_PER_BLOCK), F.col("n") - F.col("_b") * COPIES_PER_BLOCK).cast("int")
        return blocks.select(*[column(c) for c in columns], F.col("side").alias(name), F.explode(F.sequence(F.lit(1), size)).alias("_c")).drop("_c")

    def train(self, df: DataFrame) -> DataFrame:
        return self._side(df, False)

    def test(self, df: DataFrame) -> DataFrame:
        return self._side(df, True)

    def _side(self, df: DataFrame, test: bool) -> DataFrame:
        if not self.cut:
            return df.where(without_nan(df, self.target).isNotNull() & (self.is_test(df) == F.lit(test)))
        return self.mark(df, "_test").where(F.col("_test") == F.lit(test)).drop("_test")


def train_quotas(counts: Sequence[int], n_train: int) -> list[int]:
    """Training rows per class: proportional shares, the remainder to the largest fractions."""
    total = sum(counts)
    shares = [c * n_train / total for c in counts]
    quotas = [math.floor(s) for s in shares]
    order = sorted(range(len(counts)), key=lambda i: (quotas[i] - shares[i], i))
    for i in order[: n_train - sum(quotas)]:
        quotas[i] += 1
    return quotas


def fit_split(
    df: DataFrame,
    target: Target,
    key: Sequence[str] | None = None,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> Split:
    """Class-proportional for classification, plain otherwise or when a class is too small.

    The sizes are exact: ceil(test_size * n) test rows. Without a key, of equal
    rows that the limit falls on each side gets its share. Rows with equal keys
    stay together, so there sizes can be off by the rows of one key.
    """
    label = without_nan(df, target.name)
    base = df.select(label.alias("label"), split_hash(df, key, seed).alias("h"))
    rows_all = None
    if target.is_classification:
        counts = {r["label"]: r["count"] for r in base.groupBy("label").count().limit(TARGET_MAX_DISTINCT + 2).collect()}
        dropped = counts.pop(None, 0)
        if len(counts) > TARGET_MAX_DISTINCT:
            raise ValueError(f"'{target.name}' has more than {TARGET_MAX_DISTINCT} classes")
        rows_all = sum(counts.values())
    else:
        r = base.agg(F.count("label").alias("n"), F.count(F.lit(1)).alias("all")).first()
        rows_all, dropped, counts = r["n"], r["all"] - r["n"], {}
    base = base.where(F.col("label").isNotNull())
    n_test = math.ceil(test_size * rows_all)
    n_train = rows_all - n_test
    if n_train < 1 or n_test < 1:
        raise ValueError(f"{rows_all} rows cannot be split into two parts")

    stratified = bool(counts) and min(counts.values()) >= 2 and n_test >= len(counts) and n_train >= len(counts)
    if stratified:
        classes = sorted(counts)
        quotas = train_quotas([counts[c] for c in classes], n_train)
        wanted = {i: counts[c] - q for i, (c, q) in enumerate(zip(classes, quotas))}
        code = None
        for i, c in enumerate(classes):
            code = F.when(F.col("label") == F.lit(c), i) if code is None else code.when(F.col("label") == F.lit(c), i)
        sizes = {i: counts[c] for i, c in enumerate(classes)}
    else:
        classes, wanted, code, sizes = [None], {0: n_test}, F.lit(0), {0: rows_all}
    found = _hash_at(base.select(code.alias("g"), "h"), wanted, sizes)
    # copies of a row at the threshold that are more than wanted stay in training; rows of one key stay together
    over = {i: 0 if key else found[i][1] - max(wanted[i], 0) for i in found}
    tested = sum(found[i][1] - over[i] for i in found)
    return Split(
        target=target.name,
        key=tuple(key) if key else None,
        seed=seed,
        stratified=stratified,
        thresholds=tuple((classes[i], found[i][0]) for i in sorted(found)),
        train_rows=rows_all - tested,
        test_rows=tested,
        dropped_rows=dropped,
        test_size=test_size,
        cut=tuple((classes[i], found[i][2] - over[i]) for i in sorted(found) if over[i] > 0),
    )


def _hash_at(base: DataFrame, wanted: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """Per group the hash of its ``wanted``-th row in hash order, the rows up to it, and the rows with that hash.

    Prefix counts narrow the search by a factor of 2^15 per pass; each pass
    returns one row per group.
    """
    # group -> (prefix, prefix bits, rows before the prefix, rows inside it)
    state = {g: (0, 0, 0, sizes[g]) for g in wanted if wanted[g] > 0}
    done = {g: (-1, 0, 0) for g in wanted if wanted[g] <= 0}
    while any(rows > RANK_ROWS and bits + PREFIX_BITS <= HASH_BITS for _, bits, _, rows in state.values()):
        bits = min(b for _, b, _, rows in state.values() if rows > RANK_ROWS) + PREFIX_BITS
        wide = {g: s for g, s in state.items() if s[3] > RANK_ROWS and s[1] + PREFIX_BITS == bits}
        prefix = F.shiftright("h", HASH_BITS - bits)
        counted = base.where(_within(wide)).groupBy("g", prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
        left = _case({g: wanted[g] - s[2] for g, s in wide.items()})
        hit = counted.withColumn("upto", upto).where((F.col("upto") >= left) & (F.col("upto") - F.col("n") < left))
        for r in hit.collect():
            before = state[r["g"]][2]
            state[r["g"]] = (r["p"], bits, before + r["upto"] - r["n"], r["n"])
    if state:
        counted = base.where(_within(state)).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
        left = _case({g: wanted[g] - s[2] for g, s in state.items()})
        hit = counted.withColumn("upto", upto).where((F.col("upto") >= left) & (F.col("upto") - F.col("n") < left))
        for r in hit.collect():
            done[r["g"]] = (r["h"], state[r["g"]][2] + r["upto"], r["n"])
    return done


def _within(state: dict[int, tuple[int, int, int, int]]) -> Column:
    cond = None
    for g, (prefix, bits, _, _) in state.items():
        here = F.col("g") == g
        if bits:
            here = here & (F.shiftright("h", HASH_BITS - bits) == F.lit(prefix))
        cond = here if cond is None else cond | here
    return cond


def _case(values: dict[int, int]) -> Column:
    out = None
    for g, v in values.items():
        out = F.when(F.col("g") == g, F.lit(v)) if out is None else out.when(F.col("g") == g, F.lit(v))
    return out
