"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are
interchangeable, so the packing is decided on the histogram of lengths (at most
``capacity`` rows, whatever the input) as patterns with multiplicities, and every piece
finds its sequence from its running number among the pieces of its length. Numbers come
from two levels (chunk offsets and ranks within a chunk), so no length is counted in one
task.

Bin completion: take the largest remaining piece, enumerate the undominated fillings of the
space it leaves, and take the fullest. The incumbent is the better of that and of best fit;
its emptiest sequences are searched by branch and bound over all undominated fillings,
cutting partial packings whose waste leaves no room for a sequence less than the incumbent.

Ids are those of the tokenizers library, added tokens in a text included.

Defined results: a null or empty text is the end token alone; repeated ids keep their own
pieces; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick
from .tokens import ADDED, encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("at", pa.int64())])


def pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, added: tuple[tuple[str, int], ...] = ADDED) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, at) with the checksum of their ids; ``ranks`` is the vocabulary's file."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, added).ids
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                out: list[list] = [[] for _ in PIECES]
                for i, at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids = memoryview(ids.tobytes() + end)
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), at), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECES, strict=True)], schema=PIECES)

    return docs.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, at long")


def _dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b fit under those of a, each into one (both in falling order)."""

    def fit(k: int, room: list[int]) -> bool:
        if k == len(b):
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= b[k] and r not in tried:
                tried.add(r)
                room[i] -= b[k]
                if fit(k + 1, room):
                    return True
                room[i] += b[k]
        return False

    return fit(0, list(a))


def _feasible(sizes: list[int], counts: Counter, room: int, steps: int) -> list[tuple[int, ...]]:
    """Sets of pieces (largest first) that fit in ``room`` and that no further piece fits into, in at most ``steps`` steps."""
    found: list[tuple[int, ...]] = []

    def search(k: int, left: int, taken: list[int]) -> None:
        nonlocal steps
        steps -= 1
        if not any(s <= left and taken.count(s) < counts[s] for s in sizes):
            found.append(tuple(taken))
        for j in range(k, len(sizes)):
            s = sizes[j]
            if s <= left and taken.count(s) < counts[s] and steps > 0:
                taken.append(s)
                search(j, left - s, taken)
                taken.pop()

    search(0, room, [])
    return [f for f in found if f]


def fillings(room: int, counts: Counter, exact: int = 16, most: int = 8) -> list[tuple[int, ...]]:
    """Undominated sets of remaining pieces that fit in ``room``, fullest first.

    All of them while at most ``exact`` pieces remain; of more, the ``most`` fullest found.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    if not sizes:
        return [()]
    if sizes[0] == room:
        return [(room,)]  # every other set fits under it
    small = sum(n for n in counts.values()) <= exact
    found = sorted(_feasible(sizes, counts, room, 1 << 20 if small else 16 * most), key=lambda f: (-sum(f), len(f), tuple(-s for s in f)))
    kept: list[tuple[int, ...]] = []
    for f in found if small else found[: 4 * most]:
        if not any(_dominated(g, f) for g in kept):
            kept.append(f)
    return (kept if small else kept[:most]) or [()]


def fullest(room: int, counts: Counter, steps: int = 256) -> tuple[int, ...]:
    """A fullest set of remaining pieces that fits in ``room``: one or two pieces that fill it, else the best of ``steps`` tries."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    have = set(sizes)
    if room in have:
        return (room,)
    for s in sizes:
        if room - s <= s and room - s in have and (room - s != s or counts[s] > 1):
            return (s, room - s)
    best: tuple[int, ...] = ()

    def search(k: int, left: int, taken: list[int]) -> bool:
        nonlocal best, steps
        steps -= 1
        if left in have and (not taken or left <= taken[-1]) and counts[left] > taken.count(left):
            best = (*taken, left)
            return True
        if room - left > sum(best):
            best = tuple(taken)
        for j in range(k, len(sizes)):
            s = sizes[j]
            if s <= left and taken.count(s) < counts[s]:
                if steps <= 0:
                    break
                taken.append(s)
                if search(j, left - s, taken):
                    return True
                taken.pop()
        return False

    search(0, room, [])
    return best


def _branch(incumbent: list[tuple[int, ...]], capacity: int, nodes: int) -> list[tuple[int, ...]]:
    """The incumbent's pieces in fewer sequences, if branch and bound over the fillings around the largest piece finds any."""
    best, left = list(incumbent), nodes

    def search(counts: Counter, total: int, bins: list[tuple[int, ...]]) -> None:
        nonlocal best, left
        if not total:
            if len(bins) < len(best):
                best = list(bins)
            return
        left -= 1
        # room for waste: what the sequences still allowed may leave empty beyond the pieces to come
        if left < 0 or (len(best) - 1 - len(bins)) * capacity < total:
            return
        top = max(s for s, n in counts.items() if n)
        counts[top] -= 1
        for f in fillings(capacity - top, counts):
            counts.subtract(f)
            search(counts, total - top - sum(f), [*bins, (top, *f)])
            counts.update(f)
        counts[top] += 1

    items = Counter(s for b in incumbent for s in b)
    search(items, sum(s * n for s, n in items.items()), [])
    return best


Plan = list[tuple[tuple[int, ...], int]]


def _best_fit_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing with sequences of one content kept together, so its size follows the lengths, not the pieces."""
    by_room: dict[int, list[list]] = {}
    for s in sorted((s for s, n in histogram.items() if n), reverse=True):
        n = histogram[s]
        while n:
            room = min((r for r, groups in by_room.items() if r >= s and groups), default=None)
            if room is None:
                each = capacity // s
                for copies, bins in ((each, n // each), (n % each, 1)):
                    if copies and bins:
                        by_room.setdefault(capacity - copies * s, []).append([(s,) * copies, bins])
                break
            pattern, bins = by_room[room].pop()
            moved = min(n, bins)
            if bins > moved:
                by_room[room].append([pattern, bins - moved])
            by_room.setdefault(room - s, []).append([(*pattern, s), moved])
            n -= moved
    return [(p, n) for groups in by_room.values() for p, n in groups]


def _completion_plan(histogram: dict[int, int], capacity: int, searched: int) -> Plan:
    """The fullest filling of the largest piece, again and again; the last pieces by best fit."""
    counts, out = Counter({s: n for s, n in histogram.items() if n}), []
    left = sum(counts.values())
    while left > searched:
        top = max(s for s, n in counts.items() if n)
        counts[top] -= 1
        filling = fullest(capacity - top, counts)
        counts[top] += 1
        pattern = (top, *filling)
        need = Counter(pattern)
        times = min(counts[s] // n for s, n in need.items())
        times = max(1, min(times, (left - searched) // len(pattern)))
        for s, n in need.items():
            counts[s] -= n * times
        left -= len(pattern) * times
        out.append((pattern, times))
    return out + _best_fit_plan(counts, capacity)


def plan(histogram: dict[int, int], capacity: int = 1024, searched: int = 60, nodes: int = 5000) -> Plan:
    """Patterns (piece lengths, how many sequences) that use every piece once.

    The incumbent is the better of best fit and of filling the largest piece first, both on
    the whole histogram. Its emptiest sequences, of up to ``searched`` pieces together, are
    packed again by branch and bound over at most ``nodes`` nodes; the others' waste is what
    bounds a better packing, so full sequences need no search. Up to 16 pieces (``fillings``)
    the search misses nothing but for that limit.
    """
    plans = [_best_fit_plan(histogram, capacity), _completion_plan(histogram, capacity, searched)]
    best = sorted(min(plans, key=lambda p: sum(n for _, n in p)), key=lambda p: (sum(p[0]), p[0]))
    rest: list[tuple[int, ...]] = []
    kept: Plan = []
    taken = 0
    for pattern, n in best:
        again = min(n, max(0, searched - taken) // len(pattern))
        rest += [pattern] * again
        taken += len(pattern) * again
        if n > again:
            kept.append((pattern, n - again))
    return kept + list(Counter(_branch(rest, capacity, nodes)).items())


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of piece numbers by length: where each begins, its first sequence and its offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for s in pattern:
            rows.append((s << 40 | used[s], used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    key, first, seq, offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return {"key": key, "first": first, "sequence": seq, "offset": offset}


def pack(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, added: tuple[tuple[str, int], ...] = ADDED, arrival: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and offset (see the module's head).

    ``arrival`` names a column of distinct whole numbers, the order in which documents should
    be met: pieces of one length then go to sequences in that order, and a sequence's number
    is the rank of its earliest piece, so sequences by number follow it.
    """
    at = F.lit(None).cast("long") if arrival is None else F.col(f"`{arrival}`").cast("long")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), at.alias("at"))
    cut = materialize(pieces(base, ranks, pattern, capacity, end_id, added))
    if arrival is None:
        chunks = max(1, math.isqrt(cut.count()))
        chunk, order = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)), ["doc_id", "piece", "ids_crc32"]
    else:
        chunk, order = F.shiftright("at", 12), ["at", "piece"]
    cut = cut.withColumn("chunk", chunk.cast("long"))
    sizes = materialize(cut.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut.withColumn("number", F.row_number().over(Window.partitionBy("length", "chunk").orderBy(*order)) - 1)
    numbered = numbered.join(offsets, ["length", "chunk"]).withColumn("number", F.col("number") + F.col("before"))
    places = _places(plan(histogram, capacity))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            number = f["number"].to_numpy(np.int64)
            k = np.searchsorted(places["key"], f["length"].to_numpy(np.int64) << 40 | number, "right") - 1
            yield f.drop(columns="number").assign(sequence_id=places["sequence"][k] + number - places["first"][k], offset=places["offset"][k])

    columns, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], "doc_id long, piece int, start long, length long, ids_crc32 long"
    if arrival is None:
        return numbered.select(*columns, "number").mapInPandas(place, f"{kinds}, sequence_id long, offset long")
    # rank of every piece in arrival order, again from chunk counts and ranks within a chunk
    chunks = sizes.groupBy("chunk").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4096 documents
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__earlier"))
    ranked = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("chunk").orderBy(*order)) - 1).join(chunks, "chunk")
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("__earlier")).cast("long"))
    put = materialize(ranked.select(*columns, "rank", "number").mapInPandas(place, f"{kinds}, rank long, sequence_id long, offset long"))
    first = put.groupBy("sequence_id").agg(F.min("rank").alias("__first"))
    return put.join(first, "sequence_id").select(*columns, F.col("__first").alias("sequence_id"), "offset")
