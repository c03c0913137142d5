"""Moments and exact order statistics without holding a column in one place.

Spark's exact ``percentile`` keeps a value map of the whole group in a single
buffer. Here a mergeable sketch only *suggests* cut points; counting around
the cuts *proves* between which cuts every wanted rank lies, and the interval
shrinks until a short list of values is left to sort. Results equal linear
interpolation on the full sorted column, whatever the sketch said.

All passes work on the long layout ``(column, value)``: aggregating k columns
as k groups generates one small loop, while k times m aggregate expressions
over a wide row generate a method too large for the JIT compiler.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.values import as_double

SKETCH_K = 2048
# Relative rank distance between a wanted rank and its two cuts. Wider than the
# sketch error, so that one round of cuts normally encloses the rank.
SKETCH_MARGIN = 0.005
# An interval with at most this many rows is sorted; a larger one is cut again.
SORT_ROWS = 500_000
# First-level sketch groups per column: bounds what one merging task receives.
MERGE_FAN_IN = 64


@dataclass(frozen=True)
class Summary:
    """Moments and quantiles of one numeric column over its non-null values."""

    rows: int
    count: int
    mean: float | None
    min: float | None
    max: float | None
    m2: float | None
    quantiles: dict[float, float | None]

    @property
    def missing(self) -> int:
        return self.rows - self.count

    @property
    def std(self) -> float | None:
        """Sample standard deviation; None below two values."""
        return math.sqrt(self.m2 / (self.count - 1)) if self.count > 1 else None

    @property
    def std_pop(self) -> float | None:
        return math.sqrt(self.m2 / self.count) if self.count else None

    @property
    def median(self) -> float | None:
        return self.quantiles[0.5]


@dataclass
class _Search:
    """Ranks of one column that are still looked for, and what is known around its cuts."""

    count: int
    ranks: set[int]
    cuts: list[float] = field(default_factory=list)
    under: dict[float, int] = field(default_factory=dict)
    upto: dict[float, int] = field(default_factory=dict)
    found: dict[int, float] = field(default_factory=dict)

    @property
    def open(self) -> set[int]:
        return self.ranks - self.found.keys()

    def interval(self, rank: int) -> tuple[float | None, float | None]:
        """The neighbouring cuts that enclose a rank."""
        above = [c for c in self.cuts if self.upto[c] <= rank]
        below = [c for c in self.cuts if self.under[c] > rank]
        return (above[-1] if above else None), (below[0] if below else None)

    def span(self, interval: tuple[float | None, float | None]) -> tuple[int, int]:
        """First rank of an open interval and the number of rows in it."""
        above, below = interval
        first = self.upto[above] if above is not None else 0
        last = self.under[below] if below is not None else self.count
        return first, last - first


def interpolation_ranks(prob: float, n: int) -> tuple[int, int, float]:
    """The two neighbouring ranks of a quantile and the weight of the second."""
    pos = prob * (n - 1)
    low = math.floor(pos)
    return low, min(low + 1, n - 1), pos - low


def numeric_summaries(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.5,)
) -> dict[str, Summary]:
    """Moments, extremes and exact quantiles of many columns.

    At most three scans unless an interval is still too large to sort: moments
    with sketches, counts around the cuts, the few values between the cuts.
    """
    names = list(columns)
    if not names:
        return {}
    # Short ids keep odd column names out of the plan.
    wide = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    ids = [f"x{i}" for i in range(len(names))]
    stats, hints = _moments(wide, ids, probs)
    searches = {}
    for x in ids:
        n = stats[x]["n"]
        if n and probs:
            ranks = {r for p in probs for r in interpolation_ranks(p, n)[:2]}
            searches[x] = _Search(n, ranks)
    _select(wide, searches, hints)

    out = {}
    for x, name in zip(ids, names):
        s = stats[x]
        quantiles: dict[float, float | None] = {}
        for p in probs:
            if not s["n"]:
                quantiles[p] = None
                continue
            low, high, frac = interpolation_ranks(p, s["n"])
            a, b = searches[x].found[low], searches[x].found[high]
            quantiles[p] = a + (b - a) * frac if a != b else a
        out[name] = Summary(s["rows"], s["n"], s["mean"], s["lo"], s["hi"], s["m2"], quantiles)
    return out


def _long(wide: DataFrame, ids: Sequence[str], exprs: Sequence[Column] | None = None) -> DataFrame:
    chosen = wide.select(*[(e if e is not None else F.col(x)).alias(x) for x, e in zip(ids, exprs or [None] * len(ids))])
    if len(ids) == 1:
        return chosen.select(F.lit(ids[0]).alias("column"), F.col(ids[0]).alias("value"))
    return chosen.unpivot([], list(ids), "column", "value")


def _margins(share: float) -> tuple[float, float]:
    return max(0.0, share - SKETCH_MARGIN), min(1.0, share + SKETCH_MARGIN)


def _moments(wide: DataFrame, ids: Sequence[str], probs: Sequence[float]):
    value = F.col("value")
    long = _long(wide, ids)
    summary = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    points = sorted({q for p in probs for q in _margins(p)})
    if points:
        # Sketches in a branch of their own: next to them the moments would lose
        # code generation.
        sketches = _sketches(long.where(value.isNotNull()))
        cuts = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in points])).alias("cuts")
        summary = summary.join(F.broadcast(sketches.select("column", cuts)), "column", "left")
    rows = {r["column"]: r for r in summary.collect()}

    stats, hints = {}, {}
    for x in ids:
        r = rows.get(x)
        if r is None:  # no rows at all
            stats[x] = {"rows": 0, "n": 0, "mean": None, "m2": None, "lo": None, "hi": None}
            continue
        m2 = r["var"] * r["n"] if r["n"] else None
        stats[x] = {"rows": r["rows"], "n": r["n"], "mean": r["mean"], "m2": m2, "lo": r["lo"], "hi": r["hi"]}
        if probs and r["n"]:
            hints[x] = set(r["cuts"])
    return stats, hints


def _select(wide: DataFrame, searches: dict[str, _Search], hints: dict[str, set[float]]) -> None:
    while any(s.open for s in searches.values()):
        _count_around(wide, searches, hints)
        short: dict[str, list] = {}
        long: dict[str, list] = {}
        for x, s in searches.items():
            for interval in sorted({s.interval(r) for r in s.open}, key=str):
                (short if s.span(interval)[1] <= SORT_ROWS else long).setdefault(x, []).append(interval)
        if short:
            _sort(wide, searches, short)
        hints = _new_cuts(wide, searches, long) if long else {}


def _zone(x: Column, cuts: Sequence[float]) -> Column:
    """Position of a value among sorted cuts: even numbers between cuts, odd ones on a cut."""
    zone = None
    for i, c in enumerate(cuts):
        before = x < F.lit(c)
        zone = F.when(before, 2 * i) if zone is None else zone.when(before, 2 * i)
        zone = zone.when(x == F.lit(c), 2 * i + 1)
    return zone.when(x.isNotNull(), 2 * len(cuts))


def _count_around(wide: DataFrame, searches: dict[str, _Search], hints: dict[str, set[float]]) -> None:
    """Exact number of values below and up to each new cut; ranks that hit a cut are settled."""
    ids = [x for x in searches if hints.get(x)]
    if not ids:
        return
    new = {x: sorted(hints[x]) for x in ids}
    zones = _long(wide, ids, [_zone(F.col(x), new[x]) for x in ids])
    counted: dict[str, dict[int, int]] = {x: {} for x in ids}
    for r in zones.where(F.col("value").isNotNull()).groupBy("column", "value").count().collect():
        counted[r["column"]][r["value"]] = r["count"]
    for x in ids:
        s, seen = searches[x], 0
        for i, c in enumerate(new[x]):
            seen += counted[x].get(2 * i, 0)
            s.under[c] = seen
            seen += counted[x].get(2 * i + 1, 0)
            s.upto[c] = seen
        s.cuts = sorted(s.under)
        uptos = [s.upto[c] for c in s.cuts]
        for r in list(s.open):
            at = bisect_left(uptos, r + 1)
            if at < len(s.cuts) and s.under[s.cuts[at]] <= r:
                s.found[r] = s.cuts[at]


def _inside(x: Column, interval: tuple[float | None, float | None]) -> Column:
    above, below = interval
    cond = x.isNotNull()
    if above is not None:
        cond = cond & (x > F.lit(above))
    if below is not None:
        cond = cond & (x < F.lit(below))
    return cond


def _any(conditions: Iterable[Column]) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def _sort(wide: DataFrame, searches: dict[str, _Search], intervals: dict[str, list]) -> None:
    """Sort the values of short intervals; only the wanted ranks come back."""
    ids = list(intervals)
    zones: dict[str, dict[int, tuple]] = {x: {} for x in ids}
    for x in ids:
        cuts = searches[x].cuts
        for iv in intervals[x]:
            zones[x][0 if iv[0] is None else 2 * (cuts.index(iv[0]) + 1)] = iv
    # The zone expression is a CASE, which Spark compiles in small pieces.
    kept = [F.when(_zone(F.col(x), searches[x].cuts).isin(*zones[x]), F.col(x)) for x in ids]
    values = _long(wide, ids, kept)
    counted = values.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # Intervals of a column do not overlap; each one is a window partition of its own.
    labelled, wanted, bases = None, [], {}
    for x in ids:
        here = F.col("column") == x
        zone = _zone(F.col("value"), searches[x].cuts)
        labelled = F.when(here, zone) if labelled is None else labelled.when(here, zone)
        for k, iv in zones[x].items():
            first = searches[x].span(iv)[0]
            bases[(x, k)] = first
            for r in searches[x].open:
                if searches[x].interval(r) == iv:
                    local = r - first
                    wanted.append(here & (F.col("k") == k) & (F.col("upto") > local) & (F.col("upto") - F.col("n") <= local))
    order = Window.partitionBy("column", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("k", labelled).withColumn("upto", F.sum("n").over(order))
    for row in ranked.where(_any(wanted)).collect():
        s, first = searches[row["column"]], bases[(row["column"], row["k"])]
        for r in s.open:
            if first + row["upto"] - row["n"] <= r < first + row["upto"]:
                s.found[r] = row["value"]


def _sketches(long: DataFrame) -> DataFrame:
    """One quantile sketch per column, merged in two levels."""
    return (
        long.groupBy("column", F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN_IN)).alias("part"))
        .agg(F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"))
        .groupBy("column")
        .agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    )


def _new_cuts(wide: DataFrame, searches: dict[str, _Search], intervals: dict[str, list]) -> dict[str, set[float]]:
    """Cuts from sketches of the intervals that are still too large to sort."""
    keys = [(x, iv) for x in intervals for iv in intervals[x]]
    ids = [f"k{i}" for i in range(len(keys))]
    spread = wide.where(_any(_inside(F.col(x), iv) for x, iv in keys)).select(
        *[F.when(_inside(F.col(x), iv), F.col(x)).alias(k) for k, (x, iv) in zip(ids, keys)]
    )
    sketches = _sketches(_long(spread, ids).where(F.col("value").isNotNull()))
    points = set()
    for x, iv in keys:
        first, rows = searches[x].span(iv)
        for r in searches[x].open:
            if searches[x].interval(r) == iv:
                points.update(_margins((r - first) / rows))
    asked = F.array(*[F.lit(p) for p in sorted(points)])
    out: dict[str, set[float]] = {}
    rows = sketches.select("column", F.kll_sketch_get_quantile_double("sketch", asked).alias("cuts")).collect()
    for r in rows:
        x = keys[ids.index(r["column"])][0]
        out.setdefault(x, set()).update(r["cuts"])
    return out
