"""SimHash near-duplicate components by pigeonhole blocks.

Fingerprints come from XXH64 of 4-word shingles. Two fingerprints with at most ``distance``
differing bits agree on at least ``blocks - distance`` of ``blocks`` blocks, so every choice
of that many blocks is one join key and a close pair shares at least one. Rows are joined on
those keys, bucket by bucket, and Hamming distances verified there. Work is on distinct
fingerprints; copies join their fingerprint's component at the end.

A bucket is searched without emitting its pairs: a breadth-first walk links each
fingerprint to its group's first member, so n members give at most n - 1 links. Buckets of
more than ``bucket_rows`` are cut into chunks, and every pair of chunks is walked by a task
of its own; no bucket is dropped or capped.

Defined results: null and empty texts have no words and fingerprint zero, linked like any
other; texts of fewer than four words hash their whole word sequence; repeated ids keep a
row each; a null id keeps its row and never names a component unless all its members' ids
are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import materialize, pick
from .components import components


def _bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint per row from its shingles' hashes: a bit is set if over half have it."""
    n = np.diff(first)
    full = np.flatnonzero(n > 0)
    out = np.zeros(len(n), np.uint64)
    if not len(full):
        return out
    ones = np.zeros((len(full), 64), np.int64)
    step = 1 << 17
    bounds = first[:-1][full]
    for a in range(0, len(hashes), step):
        part = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, a + len(part), "left")
        at = np.maximum(bounds[lo:hi] - a, 0)
        # sums of bytes stay small: widen only the totals
        ones[lo:hi] += np.add.reduceat(part, at, axis=0, dtype=np.int64)
    out[full] = np.packbits(ones * 2 > n[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(column: pa.Array, shingle: int = 4, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice of an Arrow column of texts: shingle hashes, and where each row's begin (n+1 long)."""
    digest = xxhash.xxh64_intdigest
    for _, _, buf, off in arrays.slices(column):
        raw = buf.tobytes().lower()
        starts, ends, first = arrays.words(buf, off)
        n = np.diff(first)
        # words of a row joined by one space, rows after each other
        cut = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=cut[1:])
        joined = b" ".join([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        joined = b" ".join(joined.split())
        shingles = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(shingles)])
        row = np.repeat(np.arange(len(n)), shingles)
        word = first[row] + np.arange(len(row)) - begin[row]
        stop = np.minimum(word + shingle, first[row + 1])
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(cut[word].tolist(), (cut[stop] - 1).tolist(), strict=True)), np.uint64, len(row)), begin


def shingle_fingerprints(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints of an Arrow column of texts."""
    found = [_bits(hashes, begin) for hashes, begin in shingle_hashes(column, shingle, seed)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of ``docs`` (doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = shingle_fingerprints(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_keys(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of blocks that a pair within ``distance`` must share."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def blocks_for(n: int, distance: int = 4, most_by_chance: int = 8) -> int:
    """Fewest blocks whose keys hold at most ``most_by_chance`` of n random fingerprints."""
    shared = 1
    while n > most_by_chance << (64 * shared // (distance + shared)) and shared < 6:
        shared += 1
    return distance + shared


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _walk(points: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (member, first of its group) among points."""
    free = np.arange(1, len(points))
    queue, root = [0], 0
    member, first = [], []
    while True:
        while queue and len(free):
            x = queue.pop()
            near = np.bitwise_count(points[free] ^ points[x]) <= distance
            if near.any():
                got = free[near].tolist()
                free = free[~near]
                member += got
                first += [root] * len(got)
                queue += got
        if not len(free):
            return member, first
        root = int(free[0])
        queue, free = [root], free[1:]


def _search(distance: int):
    """Walk each (key, cell) run of rows sorted by it; groups may cross batches."""

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        ids = frame[["mask", "key", "cell"]].to_numpy()
        new = np.append(True, (ids[1:] != ids[:-1]).any(axis=1)) if len(ids) else np.zeros(0, bool)
        begin = np.append(np.flatnonzero(new), len(ids))
        size = np.diff(begin)
        group = np.repeat(np.arange(len(size)), size)
        u, v = [], []
        small = size[group] <= 24
        for d in range(1, 24):  # small runs: compare each row with the d-th after it
            a = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if len(group) > d else np.zeros(0, np.int64)
            if not len(a):
                break
            a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= distance]
            u.append(fp[a + d])
            v.append(fp[a])
        for g in np.flatnonzero(size > 24):
            points = fp[begin[g] : begin[g + 1]]
            member, first = _walk(points, distance)
            u.append(points[member])
            v.append(points[first])
        none = [np.zeros(0, np.uint64)]
        out = pd.DataFrame({"u": np.concatenate(u + none).view(np.int64), "v": np.concatenate(v + none).view(np.int64)})
        return out.drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame.iloc[-1]
            open_ = ((frame["mask"] == last["mask"]) & (frame["key"] == last["key"]) & (frame["cell"] == last["cell"])).to_numpy()
            rest = frame[open_].reset_index(drop=True)
            yield links(frame[~open_].reset_index(drop=True))
        if rest is not None:
            yield links(rest)

    return run


def close_links(fps: DataFrame, distance: int = 4, blocks: int | None = None, bucket_rows: int = 512) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``fps`` (fp) that join all close ones."""
    masks = block_keys(blocks or blocks_for(fps.count(), distance), distance)
    parts = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = fps.select("fp", F.posexplode(parts).alias("mask", "bits")).select("fp", "mask", (F.col("fp").bitwiseAND(F.col("bits"))).alias("key"))
    busy = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    rows = (
        rows.join(busy, ["mask", "key"])
        .withColumn("chunks", chunks)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # the task of the pair of chunks (a, b), a <= b, has number a * chunks + b
        .withColumn("cell", (F.least("part", "other") * F.col("chunks") + F.greatest("part", "other")).cast("int"))
    )
    return rows.select("mask", "key", "cell", "fp").repartition("mask", "key", "cell").sortWithinPartitions("mask", "key", "cell").mapInPandas(_search(distance), "u long, v long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, blocks: int | None = None, bucket_rows: int = 512) -> DataFrame:
    """(doc_id, fp, component_id): components of documents whose fingerprints link up."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = materialize(fingerprints(base, shingle))
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = components(close_links(fps.select("fp"), distance, blocks, bucket_rows))
    named = fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = materialize(named.select("fp", "component").join(names, "component").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose document has its component's smallest id (rows without an id stay)."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col].cast("long") == gone["__gone"], "left_anti")
