"""Alignment of two tokenizers over the same bytes, and how often their ids are linked.

Tokens A (byte-level BPE) and B (pieces with byte fallback) of `` `` + text cover the same
bytes. Offsets where tokens of both end are cuts; between two cuts lies a group, and every A
token of a group is linked to every B token of it.

Groups come from lockstep merging: one state array holds the A and B pointers of all of a batch's
documents, each step moves the pointer that ends first (both, where they meet), emits the
groups closed by a meeting, and lets finished documents go. A long document enters as several
lanes: a lane's pointers start near its offset and step until they meet, so a step moves all
lanes and the steps are those of the longest lane, not of the longest document.

Corpus counts: a batch sends each id pair once, with the number of its documents that hold
it; sums per pair come back once per batch that asked, and documents add them up there. No
row is made per link, and a frequent pair costs a row per batch, not per document.

Defined results: texts null, empty, or whose pieces do not give their bytes back (a literal
U+2581, for instance) have no tokens; rows of one id are documents of their own; strings of special
tokens are plain text; an empty table gives an empty one. A group without a cut inside holds all
pairs of its distinct ids by definition; they are never expanded by occurrence.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices
from .chunks import Cache, cut, spread_runs, take_runs
from .common import materialize, pick

#: Stands for the tokens of a chunk that do not give its bytes back.
BROKEN = 0xFFFF
#: Bytes of text that are merged together, and bytes of a lane.
BATCH_BYTES, LANE_BYTES = 1 << 20, 1024
#: Links expanded at once; a group with more is expanded by distinct ids.
EXPAND = 1 << 19
GROUP_LINKS = 1 << 14


class Pair:
    """Both encoders and their tokens' byte lengths."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            a_bytes[rank] = token
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))

        # a chunk's first space is the one that the model puts before a text; before none it puts nothing
        space = [b.piece_to_id("▁")]

        def whole(chunk: bytes, ids: list[int], token_bytes: list[bytes]) -> bool:
            return b"".join([token_bytes[i] for i in ids]) == chunk

        def encode(chunks: list[str]) -> list[list[int]]:
            out = []
            for chunk, right in zip(chunks, b.encode([c[1:] for c in chunks], num_threads=1), strict=True):
                left, right, raw = a.encode_ordinary(chunk), right or space, chunk.encode()
                good = whole(raw, left, a_bytes) and whole(raw, right, b_bytes)
                out.append([len(left) & 0xFFFF, len(left) >> 16, *left, *right] if good else [1, 0, BROKEN, BROKEN])
            return out

        #: Number of A ids (low and high 16 bits), the A ids and the B ids of a chunk.
        self.cache = Cache(encode, "<u2", 1 << 18)

    def rows(self, chunks: pa.DictionaryArray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """A ids of a batch, per row the index of its first one, and the same of B."""
        flat, off = self.cache.flat(chunks.dictionary.to_pylist())
        n = flat[off[:-1]].astype(np.int64) + (flat[off[:-1] + 1].astype(np.int64) << 16)
        index = chunks.indices.to_numpy(zero_copy_only=False)
        out = []
        for start, size in ((off[:-1] + 2, n), (off[:-1] + 2 + n, np.diff(off) - 2 - n)):
            at, ends = spread_runs(start[index], size[index])
            out += [flat[at], ends[rows]]
        return tuple(out)


@lru_cache(maxsize=1)
def encoders(ranks: str, pattern: str, pieces: str) -> Pair:
    return Pair(ranks, pattern, pieces)


def _meet(state: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Token pair (a, b) at which each lane's pointers end together, stepping all lanes at once."""
    out = np.empty_like(state)
    lane = np.arange(state.shape[1])
    while len(lane):
        ea, eb = a_end[state[0]], b_end[state[1]]
        same = ea == eb
        if same.any():
            out[:, lane[same]] = state[:, same]
            state, lane, ea, eb = state[:, ~same], lane[~same], ea[~same], eb[~same]
        state[0] += ea < eb
        state[1] += eb < ea
    return out


def merge(a_len: np.ndarray, b_len: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray) -> np.ndarray:
    """Groups (a first, a end, b first, b end) of all documents, in their order: 4 x groups.

    Lengths are tokens' bytes; ``a_rows`` and ``b_rows`` are the documents' first tokens (n+1
    long). Documents hold tokens, and their bytes agree.
    """
    if len(a_rows) < 2:
        return np.zeros((4, 0), np.int64)
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    begin = np.concatenate([[0], a_end[a_rows[1:] - 1]])
    extra = (np.diff(begin) - 1) // LANE_BYTES
    doc = np.repeat(np.arange(len(extra)), extra)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    offset = begin[doc] + nth * LANE_BYTES
    met = _meet(np.stack([np.searchsorted(a_end, offset), np.searchsorted(b_end, offset)]), a_end, b_end) + 1
    first = np.concatenate([np.stack([a_rows[:-1], b_rows[:-1]]), met], axis=1)
    first = first[:, np.argsort(first[0], kind="stable")]
    stop = np.append(first[0, 1:], a_rows[-1])
    busy = first[0] < stop
    # rows: a pointer, b pointer, a and b where the group began, the lane's end
    state = np.concatenate([first, first, stop[None]])[:, busy]
    closed = [np.zeros((4, 0), np.int64)]
    while state.shape[1]:
        ea, eb = a_end[state[0]], b_end[state[1]]
        state[0] += ea <= eb
        state[1] += eb <= ea
        same = np.flatnonzero(ea == eb)
        if len(same):
            closed.append(state[[2, 0, 3, 1]][:, same])
            state[2:4, same] = state[0:2, same]
            over = state[0, same] >= state[4, same]
            if over.any():
                state = np.delete(state, same[over], axis=1)
    out = np.concatenate(closed, axis=1)
    return out[:, np.argsort(out[0])]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal characters of 0 .. most-1 (rows, left-aligned) and how many they are."""
    number = np.arange(most)
    width = len(str(max(most - 1, 1)))
    size = np.ones(most, np.int8)
    for k in range(1, width):
        size += number >= 10**k
    out = np.zeros((most, width + 1), np.uint8)
    for k in range(width):
        place = size.astype(np.int64) - 1 - k
        out[place >= 0, k] = 48 + number[place >= 0] // 10 ** place[place >= 0] % 10
    return out, size


def group_texts(groups: np.ndarray, a: np.ndarray, b: np.ndarray, a_rows: np.ndarray, b_rows: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2`` of every document: one run of characters and the documents' offsets."""
    a0, a1, b0, b1 = groups
    total = len(a) + len(b)
    ids, mark = np.empty(total, a.dtype), np.full(total, ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = a
    ids[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = b
    mark[a1 + b0 - 1] = ord("|")
    mark[a1 + b1 - 1] = ord(";")
    table, size = digits
    chars, size = table[ids], size[ids]
    chars[np.arange(total), size] = mark
    ends = a_rows + b_rows
    long = size + np.int8(1)
    long[ends[1:] - 1] -= 1
    return chars[np.arange(chars.shape[1], dtype=np.int8) < long[:, None]], np.concatenate([[0], np.cumsum(long, dtype=np.int64)])[ends]


def link_counts(groups: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray, b_ids: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``document * pairs + a id * b_ids + b id`` of all links, rising, and how many links each has."""
    a0, a1, b0, b1 = groups
    links = (a1 - a0) * (b1 - b0)
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def fold(key: np.ndarray, n: np.ndarray | None) -> None:
        order = np.argsort(key, kind="stable") if n is not None else None
        key = key[order] if n is not None else np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[new])
        times.append(np.diff(np.append(new, len(key))) if n is None else np.add.reduceat(n[order], new) if len(new) else n)

    small = np.flatnonzero(links <= GROUP_LINKS)
    upto, lo = np.cumsum(links[small]), 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + EXPAND, "right")))
        g = small[lo:hi]
        n = links[g]
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(b1[g] - b0[g], n)
        left = np.repeat(a0[g], n) + local // wide
        right = np.repeat(b0[g], n) + local % wide
        fold(np.repeat(doc[g], n) * pairs + a[left].astype(np.int64) * b_ids + b[right], None)
        lo = hi
    for g in np.flatnonzero(links > GROUP_LINKS):
        left, n_left = np.unique(a[a0[g] : a1[g]], return_counts=True)
        right, n_right = np.unique(b[b0[g] : b1[g]], return_counts=True)
        fold((doc[g] * pairs + left[:, None].astype(np.int64) * b_ids + right).ravel(), (n_left[:, None] * n_right).ravel())
    if len(keys) == 2:
        return keys[1], times[1]
    parts = np.concatenate(keys), np.concatenate(times)
    keys, times = [], []
    fold(*parts)
    return keys[0], times[0]


ALIGNED = pa.schema(
    [
        ("batch", pa.int64()),
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups", pa.string()),
        ("which", pa.binary()),
        ("times", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),
    ]
)
ALIGNED_COLUMNS = "batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, which binary, times binary, pairs array<long>, docs array<int>"


def _runs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of the values' bytes between rising ``ends`` (in values)."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def align(docs: DataFrame, ranks: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: batch, doc_id, n_a, n_b, n_groups, n_links, groups (text), and its linked
    pairs as places in the batch's list (``which``, 32-bit) with their links (``times``, 64-bit). A row
    per batch (``pairs`` not null) holds that list, each pair as ``a id * B's ids + b id``, and in how many of the batch's documents it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoders(ranks, pattern, pieces)
        b_ids = len(model.b_size)
        every = len(model.a_size) * b_ids
        digits = _digits(max(len(model.a_size), b_ids))
        number = TaskContext.get().partitionId() << 32
        for table in batches:
            for lo, hi, raw, off in slices(table.column(1), BATCH_BYTES):
                chunks, rows = cut(table.column(1).slice(lo, hi - lo))
                a, a_rows, b, b_rows = model.rows(chunks, rows)
                del chunks
                broken = np.concatenate([[0], np.cumsum(b == BROKEN)])[b_rows]
                good = np.flatnonzero((np.diff(broken) == 0) & (np.diff(off) > 0))
                at, a_rows = take_runs(a_rows, good)
                a = a[at]
                at, b_rows = take_runs(b_rows, good)
                b = b[at]
                groups = merge(model.a_size[a], model.b_size[b], a_rows, b_rows)
                doc = np.searchsorted(a_rows, groups[0], "right") - 1
                chars, ends = group_texts(groups, a, b, a_rows, b_rows, digits)
                key, times = link_counts(groups, doc, a, b, b_ids, every)
                owner, pair = key // every, key % every
                listed, which = np.unique(pair, return_inverse=True)
                n = hi - lo
                spread = np.zeros(n, np.int64)

                def per_row(values: np.ndarray) -> np.ndarray:
                    out = spread.copy()
                    out[good] = values
                    return out

                def row_ends(values: np.ndarray) -> np.ndarray:
                    return np.concatenate([[0], np.cumsum(per_row(values))])

                links = np.concatenate([[0], np.cumsum((groups[1] - groups[0]) * (groups[3] - groups[2]))])
                bounds = np.searchsorted(groups[0], a_rows)
                text_ends = row_ends(np.diff(ends)).astype(np.int32)
                pair_ends = row_ends(np.bincount(owner, minlength=len(good)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number)),
                        table.column(0).slice(lo, n),
                        *[pa.array(per_row(v)) for v in (np.diff(a_rows), np.diff(b_rows), np.diff(bounds), np.diff(links[bounds]))],
                        pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(text_ends), pa.py_buffer(chars)]),
                        _runs(which.astype("<i4"), pair_ends),
                        _runs(times.astype("<i8"), pair_ends),
                        pa.nulls(n, pa.list_(pa.int64())),
                        pa.nulls(n, pa.list_(pa.int32())),
                    ],
                    schema=ALIGNED,
                )
                if len(listed):
                    mine = {"batch": [number], "pairs": [listed], "docs": [np.bincount(which).astype(np.int32)]}
                    yield pa.RecordBatch.from_arrays([pa.array(mine[f.name], f.type) if f.name in mine else pa.nulls(1, f.type) for f in ALIGNED], schema=ALIGNED)
                number += 1

    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, ALIGNED_COLUMNS)


def score_links(aligned: DataFrame, b_ids: int) -> DataFrame:
    """Documents of ``aligned`` (written; other columns stay) with n_best and count_sum of their links.

    A pair's count is the number of documents that hold it linked; n_best is the links
    whose count is the highest of their A id, ties included.
    """
    pairs = aligned.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    # an A id has at most as many pairs as B has ids
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"pair div {b_ids}")))
    counts = counts.withColumn("best", best)
    asked = pairs.select("batch", "place", "pair").join(counts, "pair").select(F.col("batch").alias("owner"), "place", "n", "best")
    docs = aligned.where("pairs is null").drop("pairs", "docs")
    kept = [c for c in docs.columns if c not in ("batch", "which", "times")]

    def add(mine: pa.Table, found: pa.Table) -> pa.Table:
        n, top = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        place = found.column("place").to_numpy()
        n[place] = found.column("n").to_numpy()
        top[place] = found.column("best").to_numpy()
        rows = [np.frombuffer(w, "<i4") for w in mine.column("which").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        which = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        times = np.frombuffer(b"".join(mine.column("times").to_pylist()), "<i8")
        sums = [np.diff(np.concatenate([[0], np.cumsum(times * v[which])])[ends]) for v in (top, n)]
        return mine.select(kept).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_best long, count_sum long"
    return docs.groupBy("batch").cogroup(asked.groupBy("owner")).applyInArrow(add, schema)


def vocabulary_size(pieces: str) -> int:
    """Ids of a piece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()


def aligned_documents(docs: DataFrame, ranks: str, pattern: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256 ('' without tokens), n_best and count_sum."""
    found = align(docs, ranks, pattern, pieces, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return score_links(materialize(found.withColumn("groups_sha256", digest).drop("groups")), vocabulary_size(pieces))
