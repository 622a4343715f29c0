"""Canonical Huffman codes of limited length, in numpy.

Code lengths come from package-merge, which is optimal under the limit. Codes are canonical:
rising by (length, symbol), so the lengths alone are the code book. A stream is written most
significant bit first; every ``STEP`` symbols its bit offset is kept, so that decoding starts
anywhere and runs many places of the stream at once, one table look-up a symbol.
"""

from __future__ import annotations

import numpy as np

#: Symbols between two checkpoints.
STEP = 64


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Bits of every symbol (0 where its count is 0), at most ``longest``, by package-merge.

    A single used symbol has one bit. Equal counts are taken in symbol order.
    """
    used = np.flatnonzero(counts > 0)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit into {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64 if counts.dtype.kind == "f" else np.int64)
    levels, packages = [], weight[:0]
    for _ in range(longest):
        merged = np.concatenate([weight, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(weight))
        merged = merged[place]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


class Book:
    """Codes and the look-up table of given code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths = np.asarray(lengths, np.uint8)
        self.longest = longest = int(lengths.max(initial=1))
        symbols = np.lexsort((np.arange(len(lengths)), lengths))
        self.symbols = symbols = symbols[lengths[symbols] > 0]
        bits = lengths[symbols].astype(np.int64)
        width = np.int64(1) << (longest - bits)
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = (first >> (longest - bits)).astype(np.uint64)
        self.first, self.width = first, width

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next ``longest`` bits."""
        symbol, length = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
        n = int(self.width.sum())
        symbol[:n] = np.repeat(self.symbols, self.width)
        length[:n] = np.repeat(self.lengths[self.symbols], self.width)
        return symbol, length

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The packed stream and the bit offset of every ``STEP``-th symbol."""
        size = self.lengths[ids].astype(np.int64)
        if len(size) and not size.min():
            raise ValueError("a symbol has no code")
        ends = np.cumsum(size)
        at = ends - size
        words = int(ends[-1] + 31) // 32 + 1 if len(ends) else 0
        word, room = at >> 5, 64 - (at & 31) - size
        code = self.codes[ids] << room.astype(np.uint64)
        # bits of different symbols never overlap, so sums are unions; below 2**32 they are exact
        out = np.zeros(words + 1, np.uint64)
        out[:words] += np.bincount(word, (code >> np.uint64(32)).astype(np.float64), words).astype(np.uint64)[:words]
        out[1:] += np.bincount(word, (code & np.uint64(0xFFFFFFFF)).astype(np.float64), words).astype(np.uint64)[:words]
        total = int(ends[-1] + 7) // 8 if len(ends) else 0
        return out.astype(">u4").tobytes()[:total], at[::STEP]


class Decoder:
    """Table-driven decoding with a book's table."""

    def __init__(self, lengths: np.ndarray):
        self.book = Book(lengths)
        self.symbol, self.length = self.book.table()

    def decode(self, stream: bytes, marks: np.ndarray, n: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Symbols ``start`` to ``end`` (all by default) of a stream of ``n``; only the stretches that hold them are read."""
        end = n if end is None else min(end, n)
        if start >= end:
            return np.zeros(0, np.uint32)
        lo, hi = start // STEP, (end - 1) // STEP + 1
        words = np.frombuffer(stream + bytes(8 + -len(stream) % 4), ">u4").astype(np.uint64)
        at = marks[lo:hi].astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        shift = np.uint64(64 - self.book.longest)
        last = len(words) - 2
        for k in range(STEP):
            word = np.minimum(at >> 5, last)  # lanes past the stream's end read zeros
            window = (words[word] << np.uint64(32)) | words[word + 1]
            top = ((window << (at & 31).astype(np.uint64)) >> shift).astype(np.int64)
            out[k] = self.symbol[top]
            at += self.length[top]
        return out.T.ravel()[start - lo * STEP : end - lo * STEP]
