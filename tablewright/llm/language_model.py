"""Scoring texts with an n-gram model kept as Elias-Fano tries.

Nothing of the model is broadcast: it grows with the corpus. Texts are tokenised once into blocks of some million tokens
(written to the shared folder). A block sends the distinct tokens and token pairs it holds, with their counts in training
texts, to shards by hash; a shard adds up what it gets, builds its part of the model and answers every block in the order
it asked. Tokens are sent and answered before pairs are, so that the disk never holds both, and counts and lengths travel
compressed. A token pair is one row of a block however often it occurs, and the pairs of a context are spread over some
shards, so frequent words stay balanced.

A shard's trie has a level of contexts, monotone pointers and a level of successors, all Elias-Fano coded in
memory-mapped files, and one byte per pair: the logarithm of its joint probability c12 / N2, in steps of 1/8 of a factor
of two above the smallest one. A query finds the context, then its successor relative to it. With exact token counts the
conditional probability is smoothed towards the token's own: P(b|a) = (c12 + m P(b)) / (c(a) + m), P(b) = (c(b)+1)/(N+V+1).
A text's first token has the start of text as context, which occurs once per training text.

With ``order`` 3 a third level hangs below the pairs: the tokens that follow a pair, found by the pair's place in its
shard, where they are sent with it. P(c|a,b) = (c123 + m P(c|b)) / (c12 + m), so an unseen pair backs off to P(c|b). The
pair's count is the byte of its level. A text's first token has no pair before it. A frequent word's pairs bring all that
follows them, so they are spread over a sixteenth of the shards where there are many.

NULL texts are empty: their only token is the end. A NULL id is allowed; such rows are not used for training. Repeated
rows count and are scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import texts
from tablewright.llm.tables import stored

END, START = b" end", b" start"  # words hold no blanks
_MEMO = 1 << 17
_SENT = 4 << 20  # bytes of rows that are handed on at once
_ROW = "block long, shard int, kind string, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.string()), *[(x, pa.binary()) for x in "abcdefg"]])


@dataclass(frozen=True)
class ModelOptions:
    """``block_tokens`` and ``shard_chars`` set the size of the pieces of work, not the result."""

    mass: float = 20.0
    block_tokens: int = 1_000_000
    shard_chars: int = 32_000_000
    spread: int = 4
    order: int = 2


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def tokens(text: str) -> list[bytes]:
    """Words in lower-cased A-Z form, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], names=_NAMES)


def _rows(table: pa.Table | pa.RecordBatch) -> list[dict]:
    """Rows with their binary fields as buffers, not copies."""
    value = lambda v: v.as_buffer() if isinstance(v, pa.BinaryScalar) and v.is_valid and not isinstance(v, pa.StringScalar) else v.as_py()
    return [dict(zip(_NAMES, map(value, fields))) for fields in zip(*(table.column(c) for c in _NAMES))]


def _stable(shard: np.ndarray) -> np.ndarray:
    return np.argsort(shard, kind="stable").astype(np.int32)


def _blocks(rows: DataFrame, options: ModelOptions) -> DataFrame:
    """One row per block: ids, NULL ids and training marks (a: int64, b: 2 bytes a text), tokens per text (c), tokens as ranks (d) among the sorted distinct hashes (e)."""

    def run(batches):
        hashes, part, number = _Hashes(), TaskContext.get().partitionId(), 0
        ids, marks, sizes, words = [], [], [], []

        def block():
            flat = np.concatenate(words)
            distinct, rank = np.unique(flat, return_inverse=True)
            row = ((part << 32) + number, None, "texts", np.array(ids, np.int64).tobytes(), np.array(marks, np.uint8).tobytes(), np.array(sizes, np.int64).tobytes(), rank.astype(np.uint32).tobytes(), distinct.tobytes(), None, None)
            for x in (ids, marks, sizes, words):
                x.clear()
            return _table([row])

        for batch in batches:
            for i, train, text in zip(batch.column("id").to_pylist(), batch.column("train").to_pylist(), texts(batch, "text")):
                t = tokens(text)
                ids.append(0 if i is None else i)
                marks.append((i is not None, bool(train)))
                sizes.append(len(t))
                words.append(np.fromiter(map(hashes.__getitem__, t), np.uint64, len(t)))
                if sum(sizes) >= options.block_tokens if len(sizes) % 64 == 0 or len(t) > 10_000 else False:
                    yield block()
                    number += 1
        if ids:
            yield block()

    return rows.mapInArrow(run, _ROW)


def _train(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id and training marks of the texts of a block, their token counts, and the training mark of each token."""
    marks, sizes = np.frombuffer(row["b"], np.uint8).reshape(-1, 2).astype(bool), np.frombuffer(row["c"], np.int64)
    return marks, sizes, np.repeat(marks[:, 1], sizes)


def _token_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((_mixed(hashes) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data, length: int) -> np.ndarray:
    """The ``length`` 32-bit numbers of ``_packed``."""
    return np.frombuffer(pa.decompress(data, 4 * length, "zstd"), np.uint32)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, at.astype(np.int32)


class _Block:
    """A block with its distinct tokens, token pairs and, at order 3, triples, in the order in which shards are asked."""

    def __init__(self, row: dict, shards: int, options: ModelOptions):
        self.ids, (self.marks, self.sizes, self.train) = np.frombuffer(row["a"], np.int64), _train(row)
        self.rank, self.hashes = np.frombuffer(row["d"], np.uint32).astype(np.int64), np.frombuffer(row["e"], np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        n = len(self.hashes)
        before = np.empty(len(self.rank), np.int64)
        before[1:] = self.rank[:-1]
        before[self.first] = n  # the start of text
        self.before = before
        pairs, self.pair_of = _distinct(before * (n + 1) + self.rank)
        self.n_pairs = len(pairs)
        context, successor = np.divmod(pairs, n + 1)
        self.context = np.append(self.hashes, np.uint64(xxhash.xxh3_64_intdigest(START)))[context]
        self.successor = self.successor_hash(successor)
        mixed = _mixed(self.context) >> np.uint64(32)
        self.pair_shard = ((mixed + self.successor % np.uint64(options.spread)) % np.uint64(shards)).astype(np.int32)
        self.token_shard = _token_shard(self.hashes, shards)
        # pairs come by context; those of one shard stay in this order
        self.pair_order = _stable(self.pair_shard)
        self.token_order = _stable(self.token_shard)
        if options.order > 2:
            # a token that is not its text's first follows the pair that ends before it; triples come by pair
            follows = np.ones(len(self.rank), bool)
            follows[self.first] = False
            self.later = np.flatnonzero(follows)
            triples, self.triple_of = _distinct(self.pair_of[self.later - 1].astype(np.int64) * (n + 1) + self.rank[self.later])
            self.n_triples = len(triples)
            pair, successor = np.divmod(triples, n + 1)
            self.third = self.successor_hash(successor).astype(np.uint32)
            self.below = np.bincount(pair, minlength=self.n_pairs).astype(np.uint32)
            self.triple_shard = self.pair_shard[pair]
            self.triple_order = _stable(self.triple_shard)

    def successor_hash(self, rank: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes[rank]) >> np.uint64(32)


def _token_requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                rank, hashes = (np.frombuffer(row[c], t) for c, t in (("d", np.uint32), ("e", np.uint64)))
                count = np.bincount(rank[_train(row)[2]], minlength=len(hashes)).astype(np.uint32)
                shard = _token_shard(hashes, shards)
                yield _table([(row["block"], s, "tokens", hashes[at].tobytes(), _packed(count[at]), *[None] * 5) for s, at in _by_shard(shard, _stable(shard), shards)])

    return blocks.mapInArrow(run, _ROW)


def _pair_requests(blocks: DataFrame, shards: int, options: ModelOptions) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                x = _Block(row, shards, options)
                rows = []
                count = np.bincount(x.pair_of[x.train], minlength=x.n_pairs).astype(np.uint32)
                third = {}
                if options.order > 2:
                    triples = np.bincount(x.triple_of[x.train[x.later]], minlength=x.n_triples).astype(np.uint32)
                    third = dict(_by_shard(x.triple_shard, x.triple_order, shards))
                for s, at in _by_shard(x.pair_shard, x.pair_order, shards):
                    context = x.context[at]
                    start = np.flatnonzero(np.diff(context, prepend=context[:1] ^ np.uint64(1)))
                    length = np.diff(np.append(start, len(at))).astype(np.uint32)
                    below = [None] * 3
                    if options.order > 2:
                        follow = third.get(s, x.triple_order[:0])
                        below = [_packed(x.below[at]), x.third[follow].tobytes(), _packed(triples[follow])]
                    rows.append((row["block"], s, "pairs", context[start].tobytes(), _packed(length), x.successor[at].astype(np.uint32).tobytes(), _packed(count[at]), *below))
                    if sum(len(v) for r in rows for v in r[3:] if v) > _SENT:
                        yield _table(rows)
                        rows = []
                yield _table(rows)

    return blocks.mapInArrow(run, _ROW)


def _by_shard(shard: np.ndarray, order: np.ndarray, shards: int):
    ends = np.searchsorted(shard[order], np.arange(shards + 1, dtype=shard.dtype))
    for s in range(shards):
        if ends[s] < ends[s + 1]:
            yield s, order[ends[s] : ends[s + 1]]


def encode_count(count: np.ndarray) -> np.ndarray:
    """One byte per count: 0 for none, else steps of an eighth of a factor of two above one."""
    return np.where(count > 0, 1 + np.minimum(254, np.round(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


def decode_count(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 2.0 ** ((code.astype(np.float64) - 1) / 8), 0.0)


def _answer(table: pa.Table) -> pa.Table:
    """A shard: adds up, builds its part of the model, answers each block; the row of kind sums has its tokens and distinct tokens."""
    rows = _rows(table)
    out = []
    asked = [r for r in rows if r["kind"] == "tokens"]
    if asked:
        hashes = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in asked])
        counts = np.concatenate([_unpacked(r["b"], len(r["a"]) // 8) for r in asked])
        distinct, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        out.append((-1, asked[0]["shard"], "sums", np.array([total.sum(), (total > 0).sum()], np.int64).tobytes(), *[None] * 6))
        end = 0
        for r in asked:
            begin, end = end, end + len(r["a"]) // 8
            out.append((r["block"], r["shard"], "tokens", total[at[begin:end]].astype(np.int64).tobytes(), *[None] * 6))
    asked = [r for r in rows if r["kind"] == "pairs"]
    if asked:
        with tempfile.TemporaryDirectory() as folder:
            trie = _trie(asked, folder)
            for r in asked:
                pair = trie.pairs(np.frombuffer(r["a"], np.uint64), _unpacked(r["b"], len(r["a"]) // 8), np.frombuffer(r["c"], np.uint32).astype(np.uint64))
                third = None
                if r["e"] is not None:
                    third = trie.third_codes_of(pair, _unpacked(r["e"], len(r["c"]) // 4), np.frombuffer(r["f"], np.uint32).astype(np.uint64)).tobytes()
                out.append((r["block"], r["shard"], "pairs", trie.codes_of(pair).tobytes(), third, *[None] * 5))
    return pa.Table.from_batches([_table(out)], _SCHEMA)


def _trie(asked: list[dict], folder: str):
    from tablewright.llm.eliasfano import Trie

    pairs, count, third, held, begin = [], [], [], 0, 0
    names, number = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in asked]), return_inverse=True)
    number = number.astype(np.uint64) << np.uint64(32)
    for r in asked:
        n = _unpacked(r["d"], len(r["c"]) // 4)
        seen, end = n > 0, begin + len(r["a"]) // 8
        pairs.append((np.repeat(number[begin:end], _unpacked(r["b"], end - begin)) | np.frombuffer(r["c"], np.uint32))[seen])
        count.append(n[seen])
        begin = end
        if r["e"] is not None:
            # the pair of a triple that occurs in training texts occurs there too
            m = _unpacked(r["g"], len(r["f"]) // 4)
            pair = np.repeat((held + np.cumsum(seen) - 1).astype(np.int32), _unpacked(r["e"], len(n)))
            third.append((pair[m > 0], np.frombuffer(r["f"], np.uint32)[m > 0], m[m > 0]))
        held += len(count[-1])
    pairs, count = np.concatenate(pairs), np.concatenate(count)
    order = np.argsort(pairs)
    pairs, count = pairs[order], count[order]
    new = np.ones(len(order), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    start = np.flatnonzero(new)
    pairs, total = pairs[start], _sums(count, start)
    context, successor = names[pairs >> np.uint64(32)], pairs & np.uint64(0xFFFFFFFF)
    below = None
    if third:
        place = np.empty(len(order), np.uint64)
        place[order] = np.cumsum(new) - 1
        del order, new, start, count
        key = np.concatenate([(place[pair] << np.uint64(32)) | last for pair, last, _ in third])
        count = np.concatenate([n for _, _, n in third])
        third.clear()
        order = np.argsort(key)
        key, count = key[order], count[order]
        start = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1)))
        below = (key[start] >> np.uint64(32), key[start] & np.uint64(0xFFFFFFFF), encode_count(_sums(count, start)))
        del key, count, order, start
    return Trie(folder, context, successor, encode_count(total), below)


def _sums(count: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(count, start, dtype=np.int64) if len(start) else count.astype(np.int64)


def _scores(shards: int, options: ModelOptions, n: int, v: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        x = _Block(next(r for r in rows if r["kind"] == "texts"), shards, options)
        count, codes = np.zeros(len(x.hashes), np.int64), np.zeros(x.n_pairs, np.uint8)
        answer = {(r["kind"], r["shard"]): (r["a"], r["b"]) for r in rows if r["kind"] != "texts"}
        for s, at in _by_shard(x.token_shard, x.token_order, shards):
            count[at] = np.frombuffer(answer["tokens", s][0], np.int64)
        for s, at in _by_shard(x.pair_shard, x.pair_order, shards):
            codes[at] = np.frombuffer(answer["pairs", s][0], np.uint8)
        own = (count + 1) / (n + v + 1)
        end = np.searchsorted(x.hashes, np.uint64(xxhash.xxh3_64_intdigest(END)))
        context = np.append(count, count[end])  # texts start as often as they end
        smoothed = (decode_count(codes)[x.pair_of] + options.mass * own[x.rank]) / (context[x.before] + options.mass)
        # a quantised count may exceed its context's by a rounding step
        smoothed = np.minimum(smoothed, 1.0)
        if options.order > 2:
            third = np.zeros(x.n_triples, np.uint8)
            for s, at in _by_shard(x.triple_shard, x.triple_order, shards):
                third[at] = np.frombuffer(answer["pairs", s][1], np.uint8)
            pair = decode_count(codes)[x.pair_of[x.later - 1]]
            smoothed[x.later] = (decode_count(third)[x.triple_of] + options.mass * smoothed[x.later]) / (pair + options.mass)
        add = lambda values: np.add.reduceat(values, x.first)
        columns = [
            pa.array(x.ids, mask=~x.marks[:, 0]), pa.array(x.marks[:, 1]), pa.array(x.sizes),
            pa.array(add((count[x.rank] > 0).astype(np.int64))), pa.array(add(np.log10(own)[x.rank])),
            pa.array(add(np.log10(smoothed))),
        ]
        return pa.table(columns, names=["id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, options: ModelOptions | None = None, id_col="doc_id", text_col="text") -> tuple[DataFrame, int]:
    """((id, train, n_tokens, n_known, base_score, score) of every row, number of training tokens); scores are log10."""
    o = options or ModelOptions()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    # a shard of order 3 gets twice the rows for its texts
    shards = max(8, -(-size * (o.order - 1) // o.shard_chars))
    o = replace(o, spread=max(o.spread, shards // 16))
    blocks = stored(_blocks(rows, o), "blocks")
    counts, codes = (stored(asked.groupBy("shard").applyInArrow(_answer, _ROW), "answers") for asked in (_token_requests(blocks, shards), _pair_requests(blocks, shards, o)))
    sums = counts.where("kind = 'sums'").select("a").toArrow().column("a").to_pylist()  # two numbers a shard
    n, v = (int(x) for x in sum((np.frombuffer(b, np.int64) for b in sums), np.zeros(2, np.int64)))
    both = blocks.union(counts.where("kind <> 'sums'")).union(codes)
    fields = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    return both.groupBy("block").applyInArrow(_scores(shards, o, n, v), fields), n
