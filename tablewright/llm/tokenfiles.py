"""Token ids in files of fixed width: every id takes the bits that the vocabulary needs, and no more.

A file holds whole documents in ascending order of their ids. Its ids form one row of numbers that is cut into blocks of
equal count; each block begins at a byte, and the file lists the byte at which each block begins and the number of ids
before each document. Any stretch of ids is therefore read from the few blocks that hold it, unpacked in numpy without a
loop over ids. Layout, little-endian: ``HEAD``, byte offsets of the blocks and of the end (8 bytes each), ids before each
document and at the end (8 bytes each), the documents' keys (an Arrow stream of one column, so of any type that can be
ordered), the blocks.

Texts are dealt into ranges of the key by one shuffle, sorted there, encoded, packed and written. Rows of one key stay in
the order of the input table and may lie in several ranges, so a key that fills a third of the table does not meet in one
task. A file ends after ``file_bytes``; only a single document can make it larger. Spark's text sink and binaryFile source
carry the files, so any file system that Spark knows will do.

NULL and empty texts have no ids but the closing one. Documents without a key come first. Repeated rows are documents of
their own. An empty table gives no file, and its folder reads as an empty table. Only the key goes into the files, so other
columns of the table, whatever their names, have no effect.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tablewright.llm.arrow import spans
from tablewright.llm.packing import byte_of
from tablewright.llm.tables import stored

MAGIC = b"TOKB"
#: magic, version, bits of an id, ids of a block, part, ids of the part before this file, ids, documents, blocks, bytes of the keys
HEAD = struct.Struct("<4sHHIIQQQQQ")
#: Marks that are cut from the end of words.
_MARKS = ".,;:!?"
#: Words of Latin letters, without the one whose small form is two signs: normalised as they are, lowered letter by letter.
_LATIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: Stands for the end of a word; no letter.
_END = "\x00"
#: Bytes of text that are encoded together; a longer text is encoded alone.
_TEXT_BYTES = 1 << 20
_ENCODERS: dict = {}


@dataclass(frozen=True)
class FileOptions:
    """``vocabulary``: number of ids; by default one more than the largest id of the tokenizer and the closing id."""

    tokenizer_path: str
    closing_id: int | None = 1
    vocabulary: int | None = None
    block_ids: int = 4096
    file_bytes: int = 8 << 20
    # ranges of the key; by default as many as the session's shuffles have partitions
    ranges: int | None = None

    def bits(self) -> int:
        return max(1, (self.size() - 1).bit_length())

    def size(self) -> int:
        if self.vocabulary is not None:
            return self.vocabulary
        with open(self.tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])), self.closing_id or 0])


# encoding


def _holds_space(pattern: str) -> bool:
    return " " in pattern or r"\s" in pattern.replace(r"[^\s", "")


def _words_apart(spec: dict) -> bool:
    """Whether words between ASCII white space are encoded without a look at their neighbours.

    So it is if the normaliser turns white space into blanks, if the splitting drops it, and if no added token holds or
    swallows any of it.
    """
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    removed = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and not _holds_space(p["pattern"].get("Regex", " ")) for p in splits)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    known = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))
    return removed and bool(steps) and known and not loose and spec.get("post_processor") is None


def _letters_are_pieces(spec: dict) -> bool:
    """Whether a word of letters is lowered, left whole and written byte by byte."""
    steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
    split, *rest = spec["pre_tokenizer"]["pretokenizers"]
    bytes_only = [p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in rest] == [True]
    return steps == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and r"[\p{L}]+" in split["pattern"].get("Regex", "") and bytes_only


class Encoder:
    """Ids of texts as the tokenizer file's own library has them (without special tokens around the text).

    Where words do not depend on their neighbours, texts are split in Arrow and each different word of a slice is encoded
    once: words of Latin letters, with marks behind them or not, by a faster library where that is proven to be the same,
    others by the file's own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = _words_apart(spec)
        self.fast, self.last = (self.apart and _letters_are_pieces(spec) and _merger(spec, self.tokenizer.model)) or (None, None)
        # behind letters the splitting cuts before these marks, unless a token of its own holds them
        self.marks = "" if any(c in t["content"] for t in spec.get("added_tokens", []) for c in _MARKS) else _MARKS

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of unsigned 32-bit numbers for each text; NULL is empty."""
        texts = pc.fill_null(texts, "")
        if not self.apart:
            return self._plain(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        flat, sizes, which = self._parts(words.dictionary)
        at = which[words.indices.to_numpy(zero_copy_only=False)].ravel()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n)]
        return np.split(ids, np.r_[0, ends[1::2]][bounds[1:-1] - bounds[0]]) if len(texts) else []

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of sequences one behind the other, their sizes, two sequences for each word): a word's ids are those of its
        letters and those of its marks."""
        which = np.zeros((len(words), 2), np.int64)
        flat, sizes, held = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 1
        direct = np.zeros(len(words), bool)

        def add(to: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray | None = None, column: int = 0) -> None:
            nonlocal held
            which[to, column] = held + (np.arange(len(n)) if at is None else at)
            flat.append(ids)
            sizes.append(n)
            held += len(n)

        if self.fast and len(words):
            core = pc.utf8_rtrim(words, characters=self.marks) if self.marks else words
            direct = pc.match_substring_regex(core, _LATIN).to_numpy(zero_copy_only=False)
            add(direct, *self._merged(pc.utf8_lower(core.filter(pa.array(direct)))))
            marked = direct & (pc.binary_length(core).to_numpy() < pc.binary_length(words).to_numpy())
            tails = pc.replace_substring_regex(words.filter(pa.array(marked)), f"^[^{_MARKS}]+", "").dictionary_encode()
            add(marked, *_laid(self._plain(tails.dictionary.to_pylist())), tails.indices.to_numpy(zero_copy_only=False), 1)
        add(~direct, *_laid(self._plain(words.filter(pa.array(~direct)).to_pylist())))
        return np.concatenate(flat), np.concatenate(sizes), which

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each piece); the sign behind a piece stands for the end of a word."""
        if not len(pieces):
            return _laid([])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), _END)
        ids = np.array(self.fast(joined[0].as_py() + _END), "<u4")
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)


def _laid(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*parts, np.empty(0, "<u4")]), np.fromiter(map(len, parts), np.int64, len(parts))


def _merger(spec: dict, library):
    """(function from pieces that end in ``_END`` to ids, which ids end a piece) by a faster library, None if it could differ.

    That library merges two neighbours whenever they spell a token, the earliest token first; the file's library merges
    them if they are a pair of its list. A stretch that spells a token and whose ends no merge has crossed has been merged
    like the token by itself, so both agree if every token by itself is merged to that token, and tokens are numbered in
    the order of their pairs. Both are checked here for the whole vocabulary.
    """
    import tiktoken
    from tokenizers import models

    model, ending = spec["model"], spec["model"].get("end_of_word_suffix")
    if not ending or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback"):
        return None
    vocabulary, byte = model["vocab"], byte_of()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    base = set(vocabulary) - {a + b for a, b in pairs}
    inner = models.BPE(vocab=vocabulary, merges=pairs)
    alone = all([x.id for x in (library.tokenize(t[: -len(ending)]) if t.endswith(ending) else inner.tokenize(t))] == [i] for t, i in vocabulary.items())
    plain = {c for c in byte} | {c + ending for c in byte}
    if order != sorted(order) or base != plain or max(vocabulary[t] for t in base) > min(order) or not alone:
        return None
    spell = lambda t: bytes(byte[c] for c in t)
    ranks = {spell(t[: -len(ending)]) + _END.encode() if t.endswith(ending) else spell(t): i for t, i in vocabulary.items()}
    last = np.zeros(1 + max(vocabulary.values()), bool)
    last[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
    return tiktoken.Encoding("own", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, last


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# packing of bits


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` of each id, one behind the other, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.zeros((n, 32), np.uint8)
    spread[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").reshape(n)


def file_image(keys: pa.Array, ids: np.ndarray, sizes: np.ndarray, bits: int, block_ids: int, part: int, before: int) -> bytes:
    """A whole file; ``sizes`` are the numbers of ids of the documents."""
    stretches = [ids[k : k + block_ids] for k in range(0, len(ids), block_ids)]
    blocks = [pack(s, bits) for s in stretches]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    names = sink.getvalue().to_pybytes()
    first = HEAD.size + 8 * (len(blocks) + 1) + 8 * (len(keys) + 1) + len(names)
    offsets = first + np.cumsum([0, *map(len, blocks)])
    head = HEAD.pack(MAGIC, 1, bits, block_ids, part, before, len(ids), len(keys), len(blocks), len(names))
    firsts = np.r_[0, np.cumsum(sizes)]
    return b"".join([head, offsets.astype("<u8").tobytes(), firsts.astype("<u8").tobytes(), names, *blocks])


class TokenFile:
    """Reads one file; ``data`` is only looked at where it is asked for."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, version, self.bits, self.block_ids, self.part, self.before, self.n_ids, self.n_docs, blocks, names = HEAD.unpack_from(self.data)
        if magic != MAGIC or version != 1:
            raise ValueError(f"not a token file: {bytes(self.data[:6])!r}")
        at = HEAD.size
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at)
        self.firsts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at + 8 * (blocks + 1)).astype(np.int64)
        self._names = (at + 8 * (blocks + 1) + 8 * (self.n_docs + 1), names)
        if len(self.data) < self.offsets[-1]:
            raise ValueError(f"token file of {len(self.data)} bytes, {self.offsets[-1]} declared")

    def keys(self) -> pa.Array:
        at, n = self._names
        return pa.ipc.open_stream(pa.py_buffer(bytes(self.data[at : at + n]))).read_all().column(0).combine_chunks()

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, from the blocks that hold them."""
        if not 0 <= start <= start + n <= self.n_ids:
            raise IndexError(f"ids {start} to {start + n} of {self.n_ids}")
        if not n:
            return np.empty(0, "<u4")
        low, high = start // self.block_ids, (start + n - 1) // self.block_ids
        parts = []
        for b in range(low, high + 1):
            held = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, held))
        return np.concatenate(parts)[start - low * self.block_ids :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1] - self.firsts[k]))


# Spark


def write_files(docs: DataFrame, folder: str, options: FileOptions, key_col="doc_id", text_col="text") -> None:
    """Writes the ids of all texts to ``folder`` in ascending order of the key."""
    o = options
    bits, block_ids, file_bytes, path, size = o.bits(), o.block_ids, o.file_bytes, o.tokenizer_path, o.size()
    end = np.array([] if o.closing_id is None else [o.closing_id], "<u4")
    placed = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("key").asc_nulls_first(), F.col("place")]
    dealt = placed.repartitionByRange(*([o.ranges] if o.ranges else []), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        sizes: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def image() -> pa.RecordBatch:
            nonlocal before, held
            data = file_image(pa.concat_arrays(keys), np.concatenate(ids), np.array(sizes, np.int64), bits, block_ids, part, before)
            before, held = before + sum(sizes), 0
            for x in (keys, sizes, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            for first, n in spans(batch.column("text"), _TEXT_BYTES):
                begin = first
                for k, some in enumerate(encode(batch.column("text").slice(first, n)), first):
                    if len(some) and int(some.max()) >= size:
                        raise ValueError(f"id {int(some.max())} in a vocabulary of {size}")
                    ids += [some, end]
                    sizes.append(len(some) + len(end))
                    held += sizes[-1] * bits
                    if held >= 8 * file_bytes:
                        keys.append(batch.column("key").slice(begin, k + 1 - begin))
                        yield image()
                        begin = k + 1
                if begin < first + n:
                    keys.append(batch.column("key").slice(begin, first + n - begin))
        if sizes:
            yield image()

    images = dealt.select("key", "text").mapInArrow(run, "value binary")
    # one record a file; the line end behind it is no part of the format
    images.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").load(folder)
    return found.where("length > 0").select("path", "content")


def read_documents(spark: SparkSession, folder: str, key_type: str = "long", ids: bool = True) -> DataFrame:
    """(key, part, first, n_tokens, ids_crc32, path, number[, ids]): every document of the files of ``folder``.

    ``first`` counts the ids before it in its part (see ``with_starts``), ``number`` the documents before it in its file;
    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    import zlib

    names = ["key", "part", "first", "n_tokens", "ids_crc32", "path", "number"] + ["ids"] * ids
    schema = StructType.fromDDL(f"key {key_type}, part int, first long, n_tokens long, ids_crc32 long, path string, number long" + ", ids binary" * ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                file = TokenFile(content.as_buffer())
                keys, sizes = file.keys(), np.diff(file.firsts)
                # some hundred thousand ids at a time, on borders of documents
                step, begin = 1 << 18, 0
                while begin < file.n_docs:
                    end = max(begin + 1, int(np.searchsorted(file.firsts, file.firsts[begin] + step, "right")) - 1)
                    some = file.ids(int(file.firsts[begin]), int(file.firsts[end] - file.firsts[begin]))
                    cuts = np.split(some, (file.firsts[begin + 1 : end] - file.firsts[begin]))
                    m = end - begin
                    columns = [keys.slice(begin, m), pa.array([file.part] * m, pa.int32()), pa.array(file.before + file.firsts[begin:end]), pa.array(sizes[begin:end]), pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64()), pa.array([path.as_py()] * m, pa.string()), pa.array(range(begin, end), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([c.tobytes() for c in cuts], pa.binary())] * ids, names=names)
                    begin = end

    return _files(spark, folder).mapInArrow(run, schema)


def _bases(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(part, base): the ids before each part, of rows (part, n); one number a part reaches the driver."""
    base, rows = 0, []
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        rows.append((r["part"], base))
        base += r["n"]
    return spark.createDataFrame(rows, "part int, base long")


def with_starts(documents: DataFrame) -> DataFrame:
    """The documents of all files (``read_documents``) with ``start``, the number of ids before each."""
    found = stored(documents, "documents")
    bases = _bases(documents.sparkSession, found.select("part", F.col("n_tokens").alias("n")))
    return found.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("first")).drop("base")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, start, n_ids, n_docs) of every file, from its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [TokenFile(c.as_buffer()) for c in batch.column("content")]
            columns = [[f.part for f in files], [f.before for f in files], [f.n_ids for f in files], [f.n_docs for f in files]]
            yield pa.RecordBatch.from_arrays([batch.column("path")] + [pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["path", "part", "before", "n_ids", "n_docs"])

    found = stored(_files(spark, folder).mapInArrow(run, "path string, part int, before long, n_ids long, n_docs long"), "heads")
    bases = _bases(spark, found.select("part", F.col("n_ids").alias("n")))
    return found.join(F.broadcast(bases), "part").select("path", "part", (F.col("base") + F.col("before")).alias("start"), "n_ids", "n_docs")


def read_ids(spark: SparkSession, heads: DataFrame, start: int, n: int) -> DataFrame:
    """(start, ids) for the files of ``heads`` (a manifest) that hold the ``n`` ids from position ``start`` on; other files
    are not read, and of these only the blocks that hold the ids are unpacked."""
    end = start + n
    held = heads.where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start)).select("path", "start").collect()
    at = {r["path"]: r["start"] for r in held}
    if not at:
        return spark.createDataFrame([], "start long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                file, first = TokenFile(content.as_buffer()), at[path.as_py()]
                low, high = max(start, first), min(end, first + file.n_ids)
                data = file.ids(low - first, high - low).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([data], pa.binary())], names=["start", "ids"])

    return _files(spark, list(at)).mapInArrow(run, "start long, ids binary")
