"""Sequence packing: shortest-pack-first over the histogram of lengths.

Every text becomes token ids and a closing id. Whole blocks of ``size`` ids are sequences of their own; what is left of
a text, its rest, is packed. Only the histogram of rest lengths reaches the driver (``size`` numbers). Lengths are placed
longest first, each into the pack with the most room, by counts: a pattern stands for all packs of the same content.
Room that is left over is then filled by dissolving the emptiest packs into the gaps of the others, cutting rests where
a gap ends. A pattern refers to documents by length and rank, and documents find their places by a join on these two:
the rank of a document is its rank in its input partition plus a running count of partitions, so no length, however
frequent, meets in one task.

Null texts are empty and become the closing id alone. Repeated rows are packed like others. An empty table gives an
empty result. The text of a special token is that token, as the file's own library has it.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.arrow import add_columns, texts
from tablewright.llm.tables import bounded_broadcast, stored

# Fixed value: the pattern that splits text before byte-level byte-pair encoding.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}
# The faster library overflows its stack on white space of about a million characters.
_BLANK = 5_000
#: Texts that go to Python at once; their ids leave together.
_BATCH = 1_000


@dataclass(frozen=True)
class PackOptions:
    """``min_cut``: the smallest gap for which a rest is cut."""

    tokenizer_path: str
    size: int = 1024
    closing_id: int = 0
    min_cut: int = 8


def byte_of() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def plain_encoder(spec: dict):
    """Function from text to ids for a byte-level tokenizer file, without its special tokens."""
    import tiktoken

    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def long_blank(text: str) -> bool:
    """Whether white space may be too long for the faster library: a run of twice the length fills one of these pieces."""
    return any(text[k : k + _BLANK].isspace() for k in range(0, len(text) - _BLANK + 1, _BLANK))


def encoder(path: str):
    """Function from text to ids for a tokenizer file; the same ids as the file's own library, merged by a faster one.

    Texts that hold a special token, or white space that fills ``_BLANK`` characters, go to the file's own library.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        fast = plain_encoder(spec)

        def encode(text: str) -> list[int]:
            if long_blank(text) or any(t in text for t in special):
                return _own_library(path).encode(text, add_special_tokens=False).ids
            return fast(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


@cache
def _own_library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenised(docs: DataFrame, options: PackOptions, text_col="text") -> DataFrame:
    """``docs`` without the text, with ids (little-endian unsigned 32-bit), n_ids, rest (length), part, rank and blocks_before.

    rank and blocks_before count within the input partition ``part``, among documents of the same rest. Store the result before use.
    """
    seen: dict = {}

    def compute(batch):
        part = TaskContext.get().partitionId()
        if seen.get("part") != part or seen.get("attempt") != TaskContext.get().taskAttemptId():
            seen.update(part=part, attempt=TaskContext.get().taskAttemptId(), rank=defaultdict(int), blocks=defaultdict(int))
        encode = encoder(options.tokenizer_path)
        out: list[list] = [[] for _ in range(6)]
        for text in texts(batch, text_col):
            ids = encode(text)
            ids.append(options.closing_id)
            rest, blocks = len(ids) % options.size, len(ids) // options.size
            row = (np.array(ids, "<u4").tobytes(), len(ids), rest, part, seen["rank"][rest], seen["blocks"][rest])
            seen["rank"][rest] += 1
            seen["blocks"][rest] += blocks
            for c, v in zip(out, row):
                c.append(v)
        return [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]

    return add_columns(docs, "ids binary, n_ids long, rest int, part int, rank long, blocks_before long", compute).drop(text_col)


class _Packs:
    """Groups of packs of equal pattern by room: [count, slots]; a slot is (rest, first rank, start, length)."""

    def __init__(self, size: int):
        self.size, self.by_room = size, defaultdict(list)

    def add(self, count: int, slots: list[tuple]) -> None:
        if count:
            self.by_room[self.size - sum(s[3] for s in slots)].append((count, slots))

    def take(self, room: int, most: int) -> tuple[int, list[tuple]]:
        """At most ``most`` packs of a group with this room; the others of the group stay."""
        count, slots = self.by_room[room].pop()
        if count > most:
            self.by_room[room].append((count - most, _later(slots, most)))
            count = most
        if not self.by_room[room]:
            del self.by_room[room]
        return count, slots

    def groups(self):
        return [(room, count, slots) for room in sorted(self.by_room, reverse=True) for count, slots in self.by_room[room]]


def _later(slots: list[tuple], by: int) -> list[tuple]:
    """The same slots for documents whose rank is higher by ``by``."""
    return [(rest, rank + by, start, length) for rest, rank, start, length in slots]


def pack_histogram(histogram: dict[int, int], size: int, min_cut: int) -> list[tuple[int, list[tuple]]]:
    """Patterns (number of packs, slots) that hold every document of the histogram once."""
    packs = _Packs(size)
    for rest in sorted((r for r in histogram if r), reverse=True):
        rank, left = 0, histogram[rest]
        while left:
            room = max(packs.by_room, default=0)
            if room < rest:
                packs.add(left, [(rest, rank, 0, rest)])
                break
            count, slots = packs.take(room, left)
            packs.add(count, [*slots, (rest, rank, 0, rest)])
            rank, left = rank + count, left - count
    _fill_gaps(packs, size, min_cut)
    return [(count, slots) for _, count, slots in packs.groups()]


def _fill_gaps(packs: _Packs, size: int, min_cut: int) -> None:
    """Dissolves as many of the emptiest packs as the room of the others can take in."""
    spare = sum(room * count for room, count, _ in packs.groups()) // size
    loose: list[tuple[int, tuple]] = []  # (number of documents, slot)
    while spare > 0 and packs.by_room:
        room = max(packs.by_room)
        count, slots = packs.take(room, spare)
        spare -= count
        loose += [(count, s) for s in slots]
    loose.sort(key=lambda x: x[1][3])
    while loose:
        count, (rest, rank, start, length) = loose.pop()
        fitting = [r for r in packs.by_room if r >= length]
        room = min(fitting) if fitting else max(packs.by_room, default=0)
        if not fitting and room < min_cut:
            packs.add(count, [(rest, rank, start, length)])
            continue
        n, slots = packs.take(room, count)
        put = min(room, length)
        packs.add(n, [*slots, (rest, rank, start, put)])
        if put < length:
            loose.append((n, (rest, rank, start + put, length - put)))
        if n < count:
            loose.append((count - n, (rest, rank + n, start, length)))


def _places(patterns: list[tuple[int, list[tuple]]]) -> list[tuple]:
    """(rest, lo, hi, slots): where the pieces of the documents of a rest with rank in [lo, hi) go; slots (start, length, sequence of rank lo, offset)."""
    cuts: dict[int, list[tuple]] = defaultdict(list)
    sequence = 0
    for count, slots in patterns:
        offset = 0
        for rest, rank, start, length in slots:
            cuts[rest].append((rank, rank + count, start, length, sequence, offset))
            offset += length
        sequence += count
    out = []
    for rest, found in cuts.items():
        whole = [c for c in found if c[3] == rest]
        out += [(rest, lo, hi, [(start, length, seq, offset)]) for lo, hi, start, length, seq, offset in whole]
        parts = sorted(c for c in found if c[3] != rest)
        marks = sorted({x for c in parts for x in c[:2]})
        for lo, hi in zip(marks, marks[1:]):
            inside = [(start, length, seq + lo - a, offset) for a, b, start, length, seq, offset in parts if a <= lo and hi <= b]
            if inside:
                out.append((rest, lo, hi, sorted(inside)))
    return out


def pack(docs: DataFrame, options: PackOptions, text_col="text") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): the stored tokenised documents with an array column ``pieces`` of
    (start, length, sequence_id, offset), and one row per piece with its ids (binary) and the document's other columns."""
    spark = docs.sparkSession
    table = stored(tokenised(docs, options, text_col), "tokens", _BATCH)
    per = stored(table.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_ids div {options.size}")).alias("b")), "lengths")
    totals = per.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).orderBy("rest").collect()  # at most `size` rows
    patterns = pack_histogram({r["rest"]: r["n"] for r in totals}, options.size, options.min_cut)
    packed = sum(count for count, _ in patterns)
    first_block, bases = packed, []
    for r in totals:
        bases.append((r["rest"], first_block))
        first_block += r["b"]
    places = spark.createDataFrame(_places(patterns), "rest int, lo long, hi long, slots array<struct<start:int,length:int,seq:long,offset:int>>")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per.join(F.broadcast(spark.createDataFrame(bases, "rest int, base long")), "rest").select(
        "part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"), (F.col("base") + F.coalesce(F.sum("b").over(before), F.lit(0))).alias("block_base")
    )
    shifts = stored(shifts, "shifts")
    known = table.join(bounded_broadcast(shifts, shifts.count(), 64), ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    # patterns are bounded by the number of lengths, not by the documents
    at = known.join(F.broadcast(places.withColumnRenamed("rest", "_rest")), (F.col("rest") == F.col("_rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    blocks = F.expr(f"n_ids div {options.size}")
    piece = lambda start, length, seq, offset: F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    whole = F.when(blocks > 0, F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: piece(k * options.size, F.lit(options.size), F.col("block_base") + F.col("blocks_before") + k, F.lit(0)))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"))
    rest = F.when(F.col("slots").isNotNull(), F.transform("slots", lambda s: piece(blocks * options.size + s["start"], s["length"], s["seq"] + F.col("rank") - F.col("lo"), s["offset"]))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"))
    keep = [c for c in docs.columns if c != text_col]
    placed = at.select(*keep, "n_ids", "ids", F.concat(whole, rest).alias("pieces"))
    cut = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in ("start", "length", "sequence_id", "offset")], F.expr("ids").substr(p["start"].cast("int") * 4 + 1, p["length"].cast("int") * 4).alias("ids")))
    pieces = placed.select(*keep, "n_ids", F.explode(cut).alias("p")).select(*keep, "n_ids", "p.*")
    return placed, pieces


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumnRenamed("n_ids", "doc_tokens")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order; at most `size` ids meet in a group."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))).alias("p"))
    return rows.select("sequence_id", F.unhex(F.array_join("p.h", "")).alias("ids"))
