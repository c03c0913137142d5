"""Alignment of the tokens of two tokenizers over the same text, and how often their ids meet in a corpus.

Both token lists of a text spell the same bytes. The byte at which a token ends is its cumulative end; a dictionary for
each side leads from ends to token numbers. The ends that both dictionaries hold, sorted, cut both id lists into groups,
and within a group every pair of tokens whose bytes overlap is a link.

Where neither tokenizer has a token across the blanks between words, each different stretch between blanks is encoded and
aligned once for some megabytes of text. Whether that holds is read from the files (the splitting of the first, the pieces
of the second); if not, texts are encoded and aligned whole.

How often a pair of ids is linked is counted over all texts. Pairs are joined back to texts in two parts: the most frequent
ones, as many as a broadcast of bounded size takes, whose least count follows from a histogram of counts, and the rest by a
shuffle, in which no pair has more rows than that count. So the bulk of the links never leaves its task, at any size.

The first file is a byte-level BPE of the tokenizers library, whose special tokens in texts are plain text, the second a
piece model with a blank before the text, which the first gets too. NULL and empty texts, and those that either side cannot
spell, have no tokens. Repeated rows count as often as they occur. An empty table gives an empty result. Texts are treated
whole, in one task each. Input columns stay as they are; new columns whose names are taken get underscores.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import column
from tablewright.llm.arrow import append_columns, free_names
from tablewright.llm.packing import byte_of, long_blank, plain_encoder
from tablewright.llm.tables import BROADCAST_BYTES, stored

#: White space of Unicode, in which the first side's splitting never ends a token before a blank.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BORDER = re.compile(f"(?<=[^{_BLANK}]) ")
_LOOSE = re.compile(f"(?:^|[{_BLANK}]) ")
#: Stretches that are encoded as one text.
_TOGETHER = 1000
#: Bytes of a row of a broadcast of pairs.
_PAIR_BYTES = 32


@dataclass(frozen=True)
class AlignOptions:
    first_path: str
    second_path: str


class ByteSide:
    """A byte-level BPE file; every text gets a blank in front."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        split = spec.get("pre_tokenizer") or {}
        self.apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not spec.get("normalizer") and all(t["special"] for t in spec.get("added_tokens", []))
        # the faster library has the same ids for the usual splitting
        self.fast = plain_encoder(spec) if self.apart else None
        byte = byte_of()
        names = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.spelt = [names.get(i, b"") for i in range(1 + max(names, default=0))]

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not long_blank(text):
            return self.fast(" " + text)
        return self._library().encode(" " + text, add_special_tokens=False).ids

    @cache
    def _library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer


class PieceSide:
    """A piece model that writes blanks as U+2581 and sets one in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelt = []
        for i, piece in enumerate(pieces):
            if self.model.is_byte(i):
                self.spelt.append(bytes([int(piece[1:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.spelt.append(b"")
            else:
                self.spelt.append(piece.replace("▁", " ").encode())
        inside = any("▁" in p.lstrip("▁") for p in pieces)
        # blanks are kept and nothing is normalised away
        plain = self.model.decode(self.model.encode(" a  b Åﬁ ")) == " a  b Åﬁ "
        self.apart = not inside and plain
        self.blank = self.model.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the model sets no blank before an empty text, which here is a stretch between two blanks
        return [ids or [self.blank] for ids in self.model.encode(texts, num_threads=1)]


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of groups, tokens of a before each end, tokens of b before each end, a of each link, b of each link) of two token
    lists that spell the same bytes, from their cumulative ends, which ascend."""
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    p, q = (np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (a_at, b_at))
    common = np.array(common, np.int64)
    # within its group a token of a meets the tokens of b from the one that holds its first byte to the one that holds its last
    a_sizes = np.diff(p, prepend=0)
    b_first, b_last = np.repeat(np.r_[0, q[:-1]], a_sizes) if len(q) else q, np.repeat(q, a_sizes) - 1
    starts = np.r_[0, a_ends[:-1]] if len(a_ends) else a_ends
    single = b_first == b_last
    low, high = b_first, b_last
    several = np.flatnonzero(~single)
    low[several] = np.searchsorted(b_ends, starts[several], "right")
    high[several] = np.searchsorted(b_ends, a_ends[several], "left")
    n = high - low + 1
    a_of = np.repeat(np.arange(len(a_ends)), n)
    b_of = np.arange(len(a_of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return common, p, q, a_of, b_of


class Aligner:
    """Alignments of stretches of text; None if a side cannot spell the stretch.

    An alignment is (tokens of a, tokens of b, groups, text of the groups as numbers in ``written``, links as numbers
    a * 2**32 + b).
    """

    def __init__(self, options: AlignOptions):
        self.a, self.b = ByteSide(options.first_path), PieceSide(options.second_path)
        self.apart = self.a.apart and self.b.apart
        self.a_sizes, self.b_sizes = (np.array([*map(len, side.spelt)], np.int64) for side in (self.a, self.b))
        # ids with what follows them in the text of groups: "," or "|" on the first side, ",", ";" or nothing on the second
        n, m = len(self.a_sizes), len(self.b_sizes)
        self.written = pa.array([f"{i}{c}" for c in ",|" for i in range(n)] + [f"{i}{c}" for c in (",", ";", "") for i in range(m)])

    def split(self, texts: list[str | None]) -> pa.ListArray:
        """What lies between the blanks at which both sides cut, for each text; each stands for a blank and itself."""
        if not self.apart:
            return pa.array([[t] if t else [] for t in texts], pa.list_(pa.string()))
        # blanks behind other white space are no borders; the few texts that have them are split apart from the others
        loose = [k for k, t in enumerate(texts) if not t or _LOOSE.search(t)]
        order = np.empty(len(texts), np.int64)
        rest = np.setdiff1d(np.arange(len(texts)), loose)
        order[rest], order[loose] = np.arange(len(rest)), len(rest) + np.arange(len(loose))
        usual = pc.split_pattern(pa.array([texts[k] for k in rest], pa.string()), " ")
        others = pa.array([_BORDER.split(texts[k]) if texts[k] else [] for k in loose], usual.type)
        return pa.concat_arrays([usual, others]).take(pa.array(order)) if loose else usual

    def __call__(self, stretches: list[str]) -> list[tuple | None]:
        """Alignments of some different stretches."""
        # a stretch that ends in white space cannot be joined to the next
        single = [k for k, s in enumerate(stretches) if not self.apart or not s or s[-1].isspace()]
        joined = np.setdiff1d(np.arange(len(stretches)), single).tolist()
        found: list[tuple | None] = [None] * len(stretches)
        for some in [joined[i : i + _TOGETHER] for i in range(0, len(joined), _TOGETHER)] + [[k] for k in single]:
            for k, one in zip(some, self._encoded([stretches[k] for k in some])):
                found[k] = one or None
        return found

    def _encoded(self, some: list[str]) -> list[tuple]:
        """Alignment of each stretch, () if a side cannot spell it."""
        text = " ".join(some)
        a, b = self.a.encode(text), self.b.encode(some)
        want, flat = (" " + text).encode(), [i for ids in b for i in ids]
        if b"".join(map(self.a.spelt.__getitem__, a)) != want or b"".join(map(self.b.spelt.__getitem__, flat)) != want:
            return [()] if len(some) == 1 else [self._encoded([s])[0] for s in some]
        a, b_sizes, b = np.array(a, np.int64), [*map(len, b)], np.array(flat, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common, p, q, a_of, b_of = align(a_ends, b_ends)
        # the first token, group, sign and link of each stretch, and the number of all at the end
        b_cuts = np.cumsum([0, *b_sizes])
        g_cuts = np.searchsorted(q, b_cuts, "right")
        a_cuts = np.r_[0, p][g_cuts]
        cuts = [x.tolist() for x in (a_cuts, b_cuts, g_cuts, 4 * (a_cuts + b_cuts), 8 * np.searchsorted(a_of, a_cuts))]
        signs, links = self._signs(a, b, p, q).astype("<u4").tobytes(), (a[a_of] << 32 | b[b_of]).tobytes()
        rows = zip(*(zip(x, x[1:]) for x in cuts))
        return [(a2 - a1, b2 - b1, g2 - g1, signs[s1:s2], links[l1:l2]) for (a1, a2), (b1, b2), (g1, g2), (s1, s2), (l1, l2) in rows]

    def _signs(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Numbers in ``written`` of the text of all groups, with ";" at the end of each."""
        n, m = len(self.a_sizes), len(self.b_sizes)
        a_word, b_word = a.copy(), b + 2 * n
        a_word[p - 1] += n
        b_word[q - 1] += m
        a_sizes, b_sizes, words = np.diff(p, prepend=0), np.diff(q, prepend=0), np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.repeat(q - b_sizes, a_sizes)] = a_word
        words[np.arange(len(b)) + np.repeat(p, b_sizes)] = b_word
        return words


@cache
def _aligner(options: AlignOptions) -> Aligner:
    return Aligner(options)


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:int>>"


def _gathered(parts: list[bytes], kind: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of the parts ``at`` one behind the other, how many each of them has)."""
    flat = np.frombuffer(b"".join(parts), kind)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // flat.itemsize
    n = sizes[at]
    return flat[np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n), n)], n


def _columns(texts: list[str | None], aligner: Aligner) -> list[pa.Array]:
    split = aligner.split(texts)
    words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found = aligner(words.dictionary.to_pylist())
    flat = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    wrong = np.array([x is None for x in found], bool)
    if wrong.any():
        # no tokens for a text that a side cannot spell
        spelt = ~np.isin(text_of, text_of[wrong[flat]])
        flat, text_of = flat[spelt], text_of[spelt]
    found = [x or (0, 0, 0, b"", b"") for x in found]
    sums = [np.bincount(text_of, np.fromiter((x[k] for x in found), np.int64, len(found))[flat], len(texts)).astype(np.int64) for k in range(3)]
    signs, _ = _gathered([x[3] for x in found], "<u4", flat)
    links, n = _gathered([x[4] for x in found], "<i8", flat)
    n_links = np.bincount(text_of, n, len(texts)).astype(np.int64)
    ends = np.cumsum(sums[0] + sums[1])
    # nothing behind the last group of a text
    last = ends[sums[0] > 0] - 1
    signs = signs.copy()
    signs[last] += len(aligner.b_sizes)
    offsets = pa.array(np.r_[0, ends].astype(np.int32))
    groups = pc.binary_join(pa.ListArray.from_arrays(offsets, aligner.written.take(pa.array(signs))), "")
    return [*map(pa.array, sums), pa.array(n_links), groups, _pairs(np.repeat(text_of, n), links, len(texts))]


def _pairs(owner: np.ndarray, links: np.ndarray, texts: int) -> pa.Array:
    """The distinct links of each text with their number."""
    order = np.lexsort((links, owner))
    owner, links = owner[order], links[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (links[1:] != links[:-1])][: len(links)])
    n = np.diff(np.r_[first, len(links)])
    rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (links[first] >> 32, links[first] & 0xFFFFFFFF, n)], names=["a", "b", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(texts + 1)).astype(np.int32)), rows)


def align_texts(docs: DataFrame, options: AlignOptions, text_col="text") -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both sides, ''
    without tokens) and ``pairs`` (a, b, n): how often which ids are linked in the text. No shuffle."""
    return append_columns(docs, _FIELDS, lambda batch: _columns(batch.column(text_col).to_pylist(), _aligner(options)), drop=(text_col,), slice_by=text_col)


def pair_counts(aligned: DataFrame, pairs: str | Column = "pairs") -> DataFrame:
    """(a, b, count, best): how often ids are linked in all texts, and whether no id of a is linked more often with this b."""
    counts = stored(aligned.select(F.inline(pairs)).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    # at most one row an id of the second vocabulary
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _least_count(counts: DataFrame, rows: int) -> int:
    """The smallest power of two such that at most ``rows`` pairs have that count or more; 1 if all fit."""
    by_size = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).count().collect()  # at most 64 rows
    fit, least = 0, 1 << 62
    for r in sorted(by_size, key=lambda r: -r["k"]):
        fit += r["count"]
        if fit > rows:
            return least
        least = 1 << r["k"]
    return 1


def link_support(aligned: DataFrame, pairs_col="pairs", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` (links whose count is the highest of their b, ties included) and
    ``count_sum`` (the counts of all links added up); both 0 without links."""
    key, *_ = free_names(aligned, ["row"])
    table = stored(aligned.withColumn(key, F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(table, pairs_col), "counts")
    least = _least_count(counts, broadcast_bytes // _PAIR_BYTES)
    links = table.select(F.col(key).alias("row"), F.inline(pairs_col))
    hot = F.broadcast(counts.where(F.col("count") >= least))
    met = links.join(hot, ["a", "b"])
    if least > 1:
        rest = links.join(hot, ["a", "b"], "left_anti").join(counts.where(F.col("count") < least), ["a", "b"])
        met = met.unionByName(rest)
    n_best, count_sum = free_names(table.drop(key, pairs_col), ["n_best", "count_sum"])
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0))
    sums = met.groupBy(F.col("row").alias(key)).agg(best.alias(n_best), F.sum(F.col("n") * F.col("count")).alias(count_sum))
    kept = [column(c) for c in table.columns if c not in (key, pairs_col)]
    return table.join(sums, key, "left").select(*kept, *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in (n_best, count_sum)])
