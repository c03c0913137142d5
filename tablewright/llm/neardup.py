"""Near duplicates by HyperMinHash sketches.

*Sketch.* The distinct word shingles of a text are hashed to 64 bits. The first bits choose one of 128 registers; a
register keeps the smallest remaining value as its number of leading zeros and ten mantissa bits, 16 bits together.
Empty registers borrow from the first filled one in a fixed random order, so that two registers agree with the
probability of the Jaccard similarity for sets of any size.

*Candidates.* Texts with equal shingle sets form a class at once. Classes that agree on a band of four registers
(32 bands; a pair at 0.8 is missed with probability 5e-8) are candidates. In the first round every class is compared
with the smallest class it shares a band with, so a group of n near copies costs n comparisons. After that only bands
that still hold several components are looked at. Members outside the largest component of a band are compared with
all members of other components where these pairs are few. In larger bands a few centres come first, then the
members that are still apart (short texts around a common line, say) are grouped anew by their rarest shingles, so
many of each text that two texts over the threshold share one. Should such a group be large as well, its outsiders
are compared with all members in blocks of bounded size, which return links only.

*Estimate and verification.* The share of agreeing registers, corrected for accidental collisions, drops pairs that lie
more than five standard errors under the threshold where they meet, so no row is made for them. The error is that of one
permutation's registers: those of a text of few shingles hold nearly all of them. The rest is confirmed on the full
shingle sets.
Links are closed to components by star contraction. No links, sets or components reach the driver.

Null and empty texts have no shingles, are linked with nothing and kept. Rows with a NULL id are returned with
component NULL and kept. Rows that repeat an id are taken for one document; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import add_columns, texts
from tablewright.llm.components import components
from tablewright.llm.tables import bounded_broadcast, few_tasks, stored

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Chance, times 2^mantissa bits, that two registers of different sets agree (published approximation of the sketch).
COLLISION = 0.169919487159739
_MIX1, _MIX2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_PROBES = np.argsort(np.random.default_rng(20).random((REGISTERS, REGISTERS)), axis=1)
_MEMO = 1 << 17
#: Rows of texts, registers or shingle sets that go to Python at once, and pairs of blocks of sets.
_BATCH, _BLOCK_PAIRS = 1_000, 8


@dataclass(frozen=True)
class NearDupOptions:
    """``group_pairs``, ``centres`` and ``block`` only decide in which order pairs are visited, not which."""

    words: int = 5
    percent: int = 80
    rows_per_band: int = 4
    group_pairs: int = 20_000
    centres: int = 6
    block: int = 256


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _STEP + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (0 = empty) of sorted distinct hashes."""
    out = np.zeros(REGISTERS, np.uint16)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] << np.uint64(BUCKET_BITS)
    high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
    zeros = np.minimum(zeros, 64 - BUCKET_BITS).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA_BITS)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS)) + mantissa + np.uint64(1)
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of registers, empty registers filled first."""
    filled = regs > 0
    if not filled.all():
        source = _PROBES[np.arange(REGISTERS), filled[_PROBES].argmax(axis=1)]
        regs = np.where(filled, regs, regs[source])
    grid = regs.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        key = _mixed(key * _STEP + grid[:, k])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two register arrays, corrected for accidental collisions."""
    union = int(((a > 0) | (b > 0)).sum())
    same = int(((a == b) & (a > 0)).sum())
    return max(0.0, (same - union * COLLISION * 2.0**-MANTISSA_BITS) / union) if union else 0.0


def sketches(docs: DataFrame, options: NearDupOptions, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n, set_id, regs) of every row; set_id and regs are NULL without words."""
    hashes = WordHashes()

    def compute(batch):
        n, ids, regs = [], [], []
        for text in texts(batch, "text"):
            s = shingle_set(text, options.words, hashes)
            n.append(len(s))
            ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(registers(s).view(np.int16) if len(s) else None)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(regs, pa.list_(pa.int16()))]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return add_columns(rows, "n long, set_id binary, regs array<short>", compute).drop("text")


def _with_bands(classes: DataFrame, options: NearDupOptions) -> DataFrame:
    """``classes`` with the band keys, which follow from ``regs`` and so need not travel with them."""

    def compute(batch):
        regs = batch.column("regs").flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS)
        return [pa.array([bands(r, options.rows_per_band) for r in regs], pa.list_(pa.int64()))]

    return add_columns(classes, "bands array<long>", compute)


def _sets(docs: DataFrame, ids: DataFrame, most: int, options: NearDupOptions, id_col: str, text_col: str, listed: bool = False) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (``most`` rows at the most): sorted 64-bit hashes, packed or as an array."""
    hashes = WordHashes()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(bounded_broadcast(ids.distinct(), most, 16), "id", "left_semi")
    kind, ddl = (pa.list_(pa.int64()), "array<long>") if listed else (pa.binary(), "binary")

    def compute(batch):
        sets = (shingle_set(t, options.words, hashes) for t in texts(batch, "text"))
        return [pa.array([x.view(np.int64) if listed else x.tobytes() for x in sets], kind)]

    return add_columns(rows, f"shingles {ddl}", compute).drop("text")


def _near(percent: int, n: tuple[str, str], regs: tuple[str, str]) -> Column:
    """Whether the estimated similarity of two classes is not clearly under the threshold, which their sizes bound as well."""
    na, nb = (F.col(c) for c in n)
    least, count = percent / 100, lambda test: F.size(F.filter(F.zip_with(*regs, test), lambda hit: hit))
    filled, same = count(lambda a, b: (a != 0) | (b != 0)), count(lambda a, b: (a == b) & (a != 0))
    # variance of the share of agreeing registers at the threshold, where both sets together have so many other shingles
    others = F.greatest((na + nb) / (1 + least) - 1, F.lit(1.0))
    error = 5 * F.sqrt(least * (1 - least) * F.greatest((1 + 1 / others) / filled - 1 / others, F.lit(0.0))) + 1 / filled
    alike = (na * 100 >= nb * percent) & (nb * 100 >= na * percent)
    return alike & (same / filled - COLLISION * 2.0**-MANTISSA_BITS >= least - error)


def _sides(classes: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(id, n, regs) of the classes in ``ids`` (``most`` rows at the most); the registers of the others are not shuffled."""
    return classes.select("id", "n", "regs").join(bounded_broadcast(ids.distinct(), most, 16), "id", "left_semi")


def _plausible(pairs: DataFrame, classes: DataFrame, options: NearDupOptions) -> DataFrame:
    """The pairs whose estimated similarity is not clearly under the threshold."""
    pairs = stored(pairs, "pairs")
    side = _sides(classes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), 2 * pairs.count())
    wide = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    return wide.where(_near(options.percent, ("na", "nb"), ("ra", "rb"))).select("a", "b")


def _links(docs: DataFrame, pairs: DataFrame, options: NearDupOptions, id_col: str, text_col: str) -> DataFrame:
    """The plausible pairs (a, b) confirmed on their full shingle sets."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = stored(_sets(docs, ids, 2 * pairs.count(), options, id_col, text_col), "sets", _BATCH)
    wide = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")

    def confirm(batch):
        out = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            sa, sb = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            out.append(100 * both >= options.percent * (len(sa) + len(sb) - both))
        return [pa.array(out, pa.bool_())]

    return stored(add_columns(wide, "linked boolean", confirm).where("linked").select("a", "b"), "links", _BATCH)


def _mixed_groups(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, id, root, main, members and outsiders of the groups of ``keyed`` (key, id) that hold several components.

    ``main`` marks the members of the group's largest component, ``outsiders`` counts the others. Of groups with the same
    members, as most bands of near copies are, only that of the smallest key is returned.
    """
    labelled = keyed.join(bounded_broadcast(roots, roots.count(), 16), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    # sums, as an id that is repeated counts each time
    digest = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"d{k}") for k in range(2)]
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), *digest)
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    mixed = largest.where("top.n < members").groupBy("members", "d0", "d1").agg(F.min(F.struct("key", "top")).alias("g"))
    mixed = mixed.select("g.key", "members", F.col("g.top.root").alias("top"), (F.col("members") - F.col("g.top.n")).alias("outsiders"))
    return labelled.join(mixed, "key").select("key", "id", "root", (F.col("root") == F.col("top")).alias("main"), "members", "outsiders")


def _by_work(keyed: DataFrame, roots: DataFrame, options: NearDupOptions):
    """The mixed groups with few pairs between components, those with many, and whether there are any of these; None without mixed groups.

    Both have ``keys``, all mixed groups of the member.
    """
    left = stored(_mixed_groups(keyed, roots), "left")
    work = F.col("outsiders") * F.col("members")
    most, rows = left.agg(F.max(work), F.count("*")).first()
    if most is None:
        return None, None, False
    mine = few_tasks(left.groupBy("id", "root").agg(F.collect_list(F.struct("key", "main", "members", "outsiders")).alias("mine")), rows)
    left = stored(mine.select("id", "root", F.array_sort(F.array_distinct("mine.key")).alias("keys"), F.explode("mine").alias("g")).select("g.*", "id", "root", "keys"), "left")
    return left.where(work <= options.group_pairs), left.where(work > options.group_pairs), most > options.group_pairs


def _joined_once(members: DataFrame, side: DataFrame) -> DataFrame:
    """``members`` with the columns of ``side`` (id, ...), which are joined once for each id and not for each of its groups."""
    own = ("id", "root", "keys")  # the same in all groups of a member
    mine = members.groupBy("id", "root").agg(F.first("keys").alias("keys"), F.collect_list(F.struct(*[c for c in members.columns if c not in own])).alias("mine"))
    wide = mine.join(side, "id")
    return wide.select(*[c for c in wide.columns if c != "mine"], F.explode("mine").alias("g")).select("*", "g.*").drop("g")


def _across(members: DataFrame, asks: Column, classes: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a > b) of members of one group, one of which ``asks``, that are in different components.

    ``keys`` are a member's groups. A pair that shares several groups is made in that of the smallest key only, and once if
    both ask.
    """
    wide = _joined_once(members.select("key", "id", "root", "keys", asks.alias("asks")), _sides(classes, members.select("id"), members.count()))
    side = lambda c: [F.col(n).alias(a) for n, a in zip(("id", "root", "n", "keys", "regs", "asks"), (c, f"r{c}", f"n{c}", f"k{c}", f"s{c}", f"a{c}"))]
    x, y = wide.where("asks").select("key", *side("x")).drop("ax"), wide.select("key", *side("y"))
    new = (F.col("rx") != F.col("ry")) & (~F.col("ay") | (F.col("x") > F.col("y")))
    once = F.array_min(F.array_intersect("kx", "ky")) == x["key"]
    both = x.join(y, (x["key"] == y["key"]) & new & once & _near(percent, ("nx", "ny"), ("sx", "sy")))
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _rare_shingles(docs: DataFrame, ids: DataFrame, options: NearDupOptions, id_col: str, text_col: str) -> DataFrame:
    """(key, id): the rarest shingles of each document, so many that two documents over the threshold share one (prefix filter)."""
    sets = _sets(docs, ids, ids.count(), options, id_col, text_col, listed=True)
    each = stored(sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles", _BATCH)
    often = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(often, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("s"))
    # shingles of one document only come first and pair it with none
    prefix = F.col("n") - F.ceil(F.col("n") * options.percent / 100) + 1 - (F.col("n") - F.size("s"))
    rare = F.slice("s", 1, F.greatest(prefix, F.lit(0)).cast("int"))["shingle"]
    return ranked.select(F.explode(rare).alias("key"), "id")


def _overlaps(sets: list[np.ndarray]):
    """A function that counts, for an array of distinct values, how many of them each of ``sets`` holds; the sets are sorted once for all arrays."""
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    found = np.zeros(len(values), bool)

    def count(own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, own)
        inside = at < len(values)
        hits = at[inside][values[at[inside]] == own[inside]]
        found[hits] = True
        out = np.bincount(owner[found[place]], minlength=len(sets))
        found[hits] = False
        return out

    return count


def _block_links(docs: DataFrame, many: DataFrame, options: NearDupOptions, id_col: str, text_col: str) -> DataFrame:
    """Links (a > b) between the outsiders of large groups and all their members, block against block, on full sets."""
    sets = stored(_sets(docs, many.select("id"), many.count(), options, id_col, text_col), "sets", _BATCH)
    rows = _joined_once(many, sets).withColumn("earlier", F.filter("keys", lambda k: k < F.col("key")))

    def blocks(part: DataFrame, size: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / options.block).cast("long"))
        return part.groupBy("key", block.alias("block")).agg(F.collect_list(F.struct("id", "root", "earlier", "shingles")).alias("rows")).drop("block")

    both = blocks(rows.where("NOT main"), "outsiders").withColumnRenamed("rows", "x").join(blocks(rows, "members").withColumnRenamed("rows", "y"), "key")

    def confirm(batches):
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.as_py(), y.as_py()
                ids, roots = (np.array([r[c] for r in y], np.int64) for c in ("id", "root"))
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in y]
                size = np.array([len(v) for v in sets])
                in_sets, in_keys = _overlaps(sets), _overlaps([np.array(r["earlier"], np.int64) for r in y])
                for r in x:
                    own = np.frombuffer(r["shingles"], np.uint64)
                    common, before = in_sets(own), in_keys(np.array(r["earlier"], np.int64))
                    linked = (100 * common >= options.percent * (size + len(own) - common)) & (roots != r["root"]) & (before == 0)
                    a += np.maximum(ids[linked], r["id"]).tolist()
                    b += np.minimum(ids[linked], r["id"]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(confirm, "a long, b long")


def _relabelled(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after ``links`` between ids; only the components they join are worked on."""
    most = links.count()
    ids = links.select(F.col("a").alias("id")).union(links.select("b"))
    # the linked ids that have a root already; the others are their own
    named = stored(few_tasks(roots.join(bounded_broadcast(ids, 2 * most, 16), "id", "left_semi"), 2 * most), "named")
    left, right = (bounded_broadcast(named.toDF(c, f"r{c}"), 2 * most, 16) for c in "ab")
    ends = links.join(left, "a", "left").join(right, "b", "left")
    joined = stored(few_tasks(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), most), 2 * most), "joined").toDF("root", "top")
    known = roots.join(bounded_broadcast(joined, 2 * most, 16), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    fresh = joined.join(bounded_broadcast(named.select("root"), 2 * most, 16), "root", "left_anti")
    return known.union(fresh)


def near_duplicates(docs: DataFrame, options: NearDupOptions | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n, component) of every row of ``docs``; component is the smallest id reachable over links."""
    o = options or NearDupOptions()
    rows = stored(sketches(docs, o, id_col, text_col), "sketches", _BATCH)
    usable = rows.where("set_id IS NOT NULL AND id IS NOT NULL")
    classes = stored(_with_bands(usable.groupBy("set_id").agg(F.min(F.struct("id", "n", "regs")).alias("c")).select("set_id", "c.*"), o), "classes", _BATCH)
    banded = classes.select("id", F.explode("bands").alias("key"))
    # band keys that at least two classes share
    shared = banded.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("centre")).where("members > 1")
    members = stored(banded.select("key", "id").join(shared, "key"), "members")
    first = members.where("centre <> id").groupBy(F.col("id").alias("a")).agg(F.min("centre").alias("b"))
    links = _links(docs, _plausible(first, classes, o), o, id_col, text_col)
    roots = stored(components(links, links.count()), "roots")
    keyed = members.select("key", "id")
    for turn in range(2):
        few, many, crowded = _by_work(keyed, roots, o)
        if few is None:
            break
        pairs, block_links = _across(few, ~F.col("main"), classes, o.percent), None
        if crowded and turn == 0:
            # most outsiders of a large group are linked with one of a few members
            draw = F.xxhash64("id").cast("double") / F.lit(2.0**64) + F.lit(0.5)
            pairs = pairs.union(_across(many, draw < F.lit(o.centres) / F.col("members"), classes, o.percent))
            keyed = many.select(*keyed.columns)
        elif crowded:
            rare = stored(_rare_shingles(docs, many.select("id"), o, id_col, text_col), "rare")
            few, many, crowded = _by_work(rare, roots, o)
            if few is not None:
                pairs = pairs.union(_across(few, ~F.col("main"), classes, o.percent))
            if crowded:
                block_links = stored(_block_links(docs, many, o, id_col, text_col), "links", _BLOCK_PAIRS)
        found = _links(docs, pairs.distinct(), o, id_col, text_col)
        roots = stored(_relabelled(roots, found if block_links is None else found.union(block_links)), "roots")
        if turn == 0 and not crowded:
            break
    classes = classes.join(roots, "id", "left").select("set_id", F.coalesce("root", "id").alias("root"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    named = rows.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_id")).alias("set_id"))
    return named.join(classes, "set_id", "left").select("id", "n", own.alias("component"))
