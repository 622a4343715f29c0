"""Encoding each distinct piece of a batch once.

``cut``: a text is cut before spaces that follow a character which is not white space. No pre-token of
the tokenizers used here crosses such a cut (white space begins a pre-token or is dropped), so
a text's ids are its chunks' ids in order. ``split`` goes further for vocabularies that drop white
space, ignore case and part letters, single digits and other runs. Tests compare both with
whole-text encoding. Arrow finds a batch's distinct chunks, and a worker keeps the ids of those
it has met.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from .arrays import text_buffer

#: Bytes after which a space may be a cut: no white space of any kind ends with one of them.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = False


#: Bytes of text that are cut together: the more, the fewer distinct chunks a byte.
CUT_BYTES = 12 << 20
#: Kinds of bytes: 0 white space, 1 letters and bytes of letters up to U+017F, 2 digits, 3 others that part from
#: letters and digits, 4 those whose word goes to the library whole (quotes and ``<`` begin contractions and added tokens).
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[[39, 60]] = 4
KIND[48:58] = 2
KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = 1
KIND[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of every text without its white space, and per row the index of its first piece (n+1 long).

    A word of ASCII and letters up to U+017F is cut into runs of letters, single digits and other runs, with A-Z in
    lower case; any other word is one piece as it is.
    """
    buf, off = text_buffer(column)
    if not len(buf):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(len(off), np.int64)
    kind = KIND[buf]
    lead = kind[:-1] == 1
    lead &= buf[:-1] >= 0xC3
    tail = np.flatnonzero(lead) + 1
    kind[tail] = 1
    kind[tail[(buf[tail - 1] == 0xC3) & ((buf[tail] == 0x97) | (buf[tail] == 0xB7))]] = 4  # multiplication and division signs
    seen = kind > 0
    start = seen.copy()
    start[1:] &= ~seen[:-1]
    rows = off[:-1][off[:-1] < len(buf)]
    start[rows] = seen[rows]
    whole = np.flatnonzero(start)
    odd = np.zeros(0, np.int64)
    strange = np.flatnonzero(kind == 4)
    if len(strange):
        odd = np.unique(np.searchsorted(whole, strange, "right") - 1)
    start[1:] |= seen[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    lower = LOWER[buf]
    if len(odd):
        ends = np.append(whole, len(buf))
        size = ends[odd + 1] - whole[odd]
        inside = np.arange(size.sum()) + np.repeat(whole[odd] - (np.cumsum(size) - size), size)
        start[inside] = False
        start[whole[odd]] = True
        lower[inside] = buf[inside]
    lower, at = lower[seen], np.flatnonzero(start[seen])
    places = np.concatenate([[0], np.cumsum(seen)])[off]
    return _strings(lower, at), np.searchsorted(at, places)


def _strings(buf: np.ndarray, at: np.ndarray) -> pa.DictionaryArray:
    ends = np.append(at, len(buf)).astype(np.int32)
    return (pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(buf)) if len(at) else pa.array([], pa.string())).dictionary_encode()


def cut(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Chunks of every text with one space before it, and per row the index of its first chunk (n+1 long).

    A null text is like an empty one: a single space.
    """
    buf, off = text_buffer(column)
    rows = len(off) - 1
    buf = np.insert(buf, off[:-1], np.uint8(32))
    off = off + np.arange(rows + 1)
    starts = buf == 32
    starts[1:] &= SOLID[buf[:-1]]
    starts[off[:-1]] = True
    at = np.flatnonzero(starts)
    return _strings(buf, at), np.searchsorted(at, off)


def take_runs(off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs off[w]:off[w+1] for every w of ``which``, one after another, and the offsets of the result."""
    return spread_runs(off[which], np.diff(off)[which])


def spread_runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start+1, .. of every run of ``size``, one run after another, and the runs' offsets in them."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    at = np.arange(ends[-1])
    at += np.repeat(start - ends[:-1], size)
    return at, ends


class Cache:
    """ids of distinct chunks by ``encode`` (list of chunks -> list of id lists); at most ``most`` are remembered."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], kind: str = "<u4", most: int = 1 << 20):
        self.encode, self.kind, self.most, self.known = encode, np.dtype(kind), most, {}

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, and the chunks' offsets in them."""
        known, pack, mark = self.known, struct.Struct, self.kind.char
        new = [c for c in texts if c not in known]
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            known.update(zip(part, [pack(f"<{len(ids)}{mark}").pack(*ids) for ids in self.encode(part)], strict=True))
        found = [known[c] for c in texts]
        if len(known) > self.most:
            known.clear()
        off = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(f) for f in found], out=off[1:])
        return np.frombuffer(b"".join(found), self.kind), off // self.kind.itemsize

    def rows(self, chunks: pa.DictionaryArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, and per row the index of its first one."""
        flat, off = self.flat(chunks.dictionary.to_pylist())
        at, ends = take_runs(off, chunks.indices.to_numpy(zero_copy_only=False))
        return flat[at], ends[rows]
