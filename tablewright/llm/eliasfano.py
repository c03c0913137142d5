"""Elias-Fano sequences and an n-gram trie of two or three levels in memory-mapped files, queried in arrays."""

from __future__ import annotations

import os

import numpy as np


class EliasFano:
    """A sorted sequence of unsigned numbers: low bits packed, high parts as a unary bit vector."""

    def __init__(self, folder: str, name: str, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        buckets = (universe >> self.low_bits) + 1
        upper = np.zeros((n + buckets + 7) // 8 * 8, np.uint8)
        upper[high + np.arange(n)] = 1
        self.upper = self._mapped(folder, f"{name}.high", np.packbits(upper, bitorder="little"))
        self.low = self._mapped(folder, f"{name}.low", self._packed(values))
        self.buckets = buckets
        # first element of each bucket, read from the unary part
        zeros = np.flatnonzero(np.unpackbits(self.upper, bitorder="little") == 0)[:buckets]
        self.first = np.zeros(len(zeros) + 1, np.int32 if n < 1 << 31 else np.int64)
        np.subtract(zeros, np.arange(len(zeros)), out=zeros)
        self.first[1:] = zeros

    @staticmethod
    def _mapped(folder: str, name: str, data: np.ndarray) -> np.ndarray:
        path = os.path.join(folder, name)
        data.tofile(path)
        return np.memmap(path, np.uint8, "r") if data.size else data

    def _packed(self, values: np.ndarray) -> np.ndarray:
        bits, out = self.low_bits, []
        step = 1 << 16  # a multiple of 8, so every chunk ends on a byte
        for i in range(0, len(values), step):
            chunk = values[i : i + step]
            flat = ((chunk[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            out.append(np.packbits(flat.ravel(), bitorder="little"))
        return np.concatenate([*out, np.zeros(8, np.uint8)])

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        window = np.lib.stride_tricks.sliding_window_view(np.asarray(self.low), 8)[bit >> 3]
        words = np.ascontiguousarray(window).view("<u8").ravel()
        return (words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def successor(self, keys: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element not under each key, within [begin, end) where given."""
        bucket = np.minimum((keys >> np.uint64(self.low_bits)).astype(np.int64), self.buckets - 1)
        lo, hi = (self.first[bucket + k].astype(np.int64) for k in (0, 1))
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        low, lo, hi = keys & np.uint64((1 << self.low_bits) - 1), lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            under = self.lows(mid) < low[open_]
            lo[open_[under]] = mid[under] + 1
            hi[open_[~under]] = mid[~under]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, keys: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, -1 where it is missing."""
        at = self.successor(keys, begin, end)
        bucket = np.minimum((keys >> np.uint64(self.low_bits)).astype(np.int64), self.buckets - 1)
        inside = at < (self.first[bucket + 1] if end is None else np.minimum(self.first[bucket + 1], end))
        found = np.full(len(keys), -1, np.int64)
        where = np.flatnonzero(inside)
        same = self.lows(at[where]) == (keys[where] & np.uint64((1 << self.low_bits) - 1))
        found[where[same]] = at[where[same]]
        return found

    def at(self, index: np.ndarray) -> np.ndarray:
        """The elements themselves."""
        bucket = np.searchsorted(self.first, index.astype(self.first.dtype), "right") - 1
        return (bucket.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(index)


class Trie:
    """Contexts (64-bit), monotone pointers to their successors (32-bit, made monotone by the context's rank), one byte each; a third level alike below each successor."""

    def __init__(self, folder: str, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, third: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """Arrays sorted by context and successor, without repeats; ``third``: index of the pair, successor and code, sorted alike."""
        start = np.flatnonzero(np.diff(context, prepend=context[:1] ^ np.uint64(1))) if len(context) else np.empty(0, np.int64)
        rank = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context)))).astype(np.uint64)
        self.contexts = EliasFano(folder, "contexts", context[start], 1 << 64)
        self.pointers = EliasFano(folder, "pointers", np.append(start, len(context)).astype(np.uint64), len(context) + 1)
        self.successors = EliasFano(folder, "successors", (rank << np.uint64(32)) | successor, max(len(start), 1) << 32)
        self.codes = EliasFano._mapped(folder, "codes", codes)
        if third:
            pair, successor, codes = third
            begin = np.searchsorted(pair, np.arange(len(context) + 1, dtype=pair.dtype)).astype(np.uint64)
            self.third_pointers = EliasFano(folder, "third_pointers", begin, len(pair) + 1)
            self.third_successors = EliasFano(folder, "third_successors", (pair << np.uint64(32)) | successor, max(len(context), 1) << 32)
            self.third_codes = EliasFano._mapped(folder, "third_codes", codes)

    def pairs(self, context: np.ndarray, length: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Index of each successor of each context (``length`` successors each), -1 where the trie has none."""
        rank = self.contexts.find(context)
        return _below(self.pointers, self.successors, rank, length, successor)

    def codes_of(self, pair: np.ndarray) -> np.ndarray:
        return _codes(self.codes, pair)

    def third_codes_of(self, pair: np.ndarray, length: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of each successor of each pair, by the pair's index."""
        return _codes(self.third_codes, _below(self.third_pointers, self.third_successors, pair, length, successor))


def _below(pointers: EliasFano, successors: EliasFano, parent: np.ndarray, length: np.ndarray, successor: np.ndarray) -> np.ndarray:
    known = np.maximum(parent, 0)
    begin, end = (pointers.at(known + k).astype(np.int64) for k in (0, 1)) if pointers.n > 1 else (known, known)
    begin, end = np.where(parent >= 0, begin, 0), np.where(parent >= 0, end, 0)
    each = lambda x: np.repeat(x, length)
    return successors.find((each(known).astype(np.uint64) << np.uint64(32)) | successor, each(begin), each(end))


def _codes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint8)
    out[at >= 0] = codes[at[at >= 0]]
    return out
