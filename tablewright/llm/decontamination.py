"""Benchmark decontamination by suffix arrays of the training texts.

Each Arrow batch of documents is a shard. Its words become ids of the benchmark's vocabulary (0: a word the benchmark
does not have), its suffixes that can match at all (those whose words are known for the length of the shortest window)
are sorted, and every benchmark suffix is binary-searched among them. The interval found holds all places of a window,
so hit words, items, longest verbatim matches and their locations come out of one pass over the documents without a
shuffle. A benchmark of more than ``block_words`` words is searched block by block.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Null texts have
no words; a benchmark row whose id is NULL is ignored, rows that share an id are one item. Repeated documents are judged
one by one; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import add_columns, texts

# Letters A-Z become a-z, digits, a-z and everything beyond ASCII stay, all else separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = "array<struct<first:int,last:int>>"
MATCHES = "array<struct<item_id:long,longest:int,doc_word:int,item_word:int>>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("longest", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())]))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class BenchmarkBlock:
    """Vocabulary and windows of some items: ``keys`` (padded word ids), ``length``, ``item`` and ``start`` of each window."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.vocabulary = width, {}
        rows, self.length, self.item, self.start = [], [], [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = min(width, len(ids))
            for q in range(len(ids) - n + 1 if n else 0):
                rows.append(ids[q : q + n] + [0] * (width - n))
                self.length.append(n)
                self.item.append(item_id)
                self.start.append(q)
        self.low = np.array(rows, np.int64).reshape(-1, width)
        self.length, self.item, self.start = (np.array(x, np.int64) for x in (self.length, self.item, self.start))

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else self.width


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that sort in the order of the rows."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def search(tokens: np.ndarray, block: BenchmarkBlock) -> tuple[np.ndarray, np.ndarray]:
    """All (place, window) with the window's words at that place of ``tokens``, by binary search in a suffix array."""
    none = np.empty(0, np.int64)
    if not len(block.low) or not len(tokens):
        return none, none
    width, n = block.width, len(tokens)
    unknown = np.flatnonzero(np.append(tokens, 0) == 0)
    run = unknown[np.searchsorted(unknown, np.arange(n))] - np.arange(n)
    places = np.flatnonzero(run >= block.shortest)
    if not len(places):
        return none, none
    padded = np.append(tokens, np.zeros(width, tokens.dtype))
    keys = _sortable(padded[places[:, None] + np.arange(width)])
    order = np.argsort(keys, kind="stable")
    suffixes, keys = places[order], keys[order]
    open_end = np.arange(width) >= block.length[:, None]
    first = np.searchsorted(keys, _sortable(block.low), "left")
    last = np.searchsorted(keys, _sortable(np.where(open_end, 0xFFFFFFFF, block.low)), "right")
    count = last - first
    window = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return suffixes[first[window] + offset], window


def _judge(batch: pa.RecordBatch, column: str, block: BenchmarkBlock, earlier: bool) -> list[pa.Array]:
    get, docs = block.vocabulary.get, []
    for text in texts(batch, column):
        w = words(text)
        docs.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    size = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(size + 1) - size - 1  # one separator after each text
    tokens = np.concatenate([np.append(d, 0) for d in docs]) if docs else np.empty(0, np.int64)
    place, window = search(tokens, block)
    doc = np.searchsorted(begin, place, "right") - 1
    spans = [[] for _ in docs] if not earlier else batch.column("hit_spans").to_pylist()
    found = [[] for _ in docs] if not earlier else batch.column("matches").to_pylist()
    if len(place):
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, place, 1)
        np.add.at(change, place + block.length[window], -1)
        hit = np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]]))
        for a, b, d in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), np.searchsorted(begin, np.flatnonzero(hit == 1), "right") - 1):
            spans[d] = _merged(spans[d], int(a - begin[d]), int(b - 1 - begin[d])) if earlier else spans[d] + [{"first": int(a - begin[d]), "last": int(b - 1 - begin[d])}]
        # windows that follow each other at the same distance in text and item make one verbatim match
        item, q = block.item[window], block.start[window]
        order = np.lexsort((place, place - q, item, doc))
        p, q, i, d, n = place[order], q[order], item[order], doc[order], block.length[window][order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        longest = n[first] + np.diff(np.append(first, len(p))) - 1
        best = np.lexsort((p[first], -longest, i[first], d[first]))
        f, longest = first[best], longest[best]
        keep = np.ones(len(f), bool)
        keep[1:] = (i[f][1:] != i[f][:-1]) | (d[f][1:] != d[f][:-1])
        for at, length in zip(f[keep], longest[keep]):
            found[d[at]].append({"item_id": int(i[at]), "longest": int(length), "doc_word": int(p[at] - begin[d[at]]), "item_word": int(q[at])})
    return [pa.array(size), pa.array(spans, _SPAN), pa.array(found, _MATCH)]


def _merged(spans: list[dict], first: int, last: int) -> list[dict]:
    """Spans with one more, overlapping and touching ones joined."""
    out = []
    for s in spans:
        if s["last"] + 1 < first or last + 1 < s["first"]:
            out.append(s)
        else:
            first, last = min(first, s["first"]), max(last, s["last"])
    return sorted([*out, {"first": first, "last": last}], key=lambda s: s["first"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col="text", item_col="item_id", item_text_col="text", block_words: int = 2_000_000) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions) and matches: the longest verbatim match of every item that has a window in the text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    letters = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-letters // (2 * block_words)))  # a word and its separator are two characters at least
    out = docs
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        block = docs.sparkSession.sparkContext.broadcast(BenchmarkBlock([(r["i"], r["t"]) for r in rows], width))
        out = add_columns(out, f"n_words long, hit_spans {SPANS}, matches {MATCHES}", lambda b, block=block, k=k: _judge(b, text_col, block.value, k > 0), slice_by=text_col)
    return out


def n_hit() -> Column:
    """Words in hit spans."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"] + 1).cast("long"))


def contaminated(percent: int = 5) -> Column:
    """Whether ``percent`` of the words, and one at least, are hit."""
    return (n_hit() > 0) & (n_hit() * 100 >= F.col("n_words") * percent)
