"""Exact removal of repeated 50-word passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the smallest hash
among its ``mmer``-word runs, so equal windows have equal minimisers wherever they stand.
Consecutive windows with one minimiser form a super-k-mer, which travels as one packed
string to the bucket of that minimiser. In a bucket, sorting ranks all windows by content
(prefix doubling on word ranks, so the comparison is exact) and gives every window the
smallest document id that holds it.

Before any text moves, minimisers are counted: a window that repeats in another document
has a minimiser that occurs in two documents, so other super-k-mers stay at home. A
minimiser with more than ``bucket_rows`` super-k-mers is spread over several buckets by
document; those buckets pass on their first holder of each window by its digest, and the
smallest holder over all buckets decides.

Defined results: a null text has no words; a null document id is never earlier or later
than another, so such a row keeps its text; rows with the same id are one document's
parts and never remove words from each other; documents shorter than the window keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .common import materialize, pick

SUPERKMERS = "doc_id long, text_key long, minimiser long, first_word int, n_windows int"
PACKED = "bucket long, spread boolean, doc_id long, text_key long, first_word int, n_windows int, packed string"
FOUND = "doc_id long, text_key long, from_word int, to_word int, digest binary"


def superkmers(docs: DataFrame, window: int = 50, mmer: int = 8) -> DataFrame:
    """One row per super-k-mer of ``docs`` (doc_id, text_key, text), without its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, _, buf, off in arrays.slices(batch.column(2)):
                starts, ends, first = arrays.words(buf, off)
                if len(starts) < window:
                    continue
                word = arrays.span_hash(buf, starts, ends)
                at = np.arange(len(word) - mmer + 1)
                least = arrays.sliding_min(arrays.span_hash(word, at, at + mmer), window - mmer + 1)
                row = np.searchsorted(first, np.arange(len(least)), "right") - 1
                whole = np.flatnonzero(np.arange(len(least)) + window <= first[row + 1])
                if not len(whole):
                    continue
                least, row = least[whole], row[whole]
                new = np.ones(len(whole), bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(whole)))
                take = pa.array(row[begin] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        keys.take(take),
                        pa.array(least[begin].view(np.int64)),
                        pa.array((whole[begin] - first[row[begin]]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                    ],
                    names=["doc_id", "text_key", "minimiser", "first_word", "n_windows"],
                )

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, SUPERKMERS)


def _pack(window: int):
    """Cut each row's chosen super-k-mers out of its text as packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.to_pydict()
            out: dict[str, list] = {k: [] for k in ("bucket", "spread", "doc_id", "text_key", "first_word", "n_windows", "packed")}
            size = 0
            for i, text in enumerate(got["text"]):
                buf = np.frombuffer(raw := (text or "").encode(), np.uint8)
                starts, ends, _ = arrays.words(buf, np.array([0, len(buf)]))
                for x in got["parts"][i]:
                    a, b = x["first_word"], x["first_word"] + x["n_windows"] + window - 2
                    words = raw[starts[a] : ends[b]].split()
                    packed = b" ".join(words).decode()
                    for k in ("bucket", "spread", "first_word", "n_windows"):
                        out[k].append(x[k])
                    out["doc_id"].append(got["doc_id"][i])
                    out["text_key"].append(got["text_key"][i])
                    out["packed"].append(packed)
                    size += len(packed)
                    if size > 4 << 20:
                        yield _batch(out, PACKED_ARROW)
                        out, size = {k: [] for k in out}, 0
            yield _batch(out, PACKED_ARROW)

    return run


PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("spread", pa.bool_()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("first_word", pa.int32()), ("n_windows", pa.int32()), ("packed", pa.string())])
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("digest", pa.binary())])


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def window_ranks(packed: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact ranks of all windows of the packed strings by sorting, and the string of each."""
    split = [p.split(" ") for p in packed]
    length = np.array([len(s) for s in split], np.int64)
    rank = pd.factorize(np.array([w for s in split for w in s], dtype=object))[0].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(length)])
    string = np.repeat(np.arange(len(split)), np.maximum(length - window + 1, 0))
    inside = np.arange(len(string)) - np.repeat(np.cumsum(np.maximum(length - window + 1, 0)) - np.maximum(length - window + 1, 0), np.maximum(length - window + 1, 0))
    at = first[string] + inside
    size = 1
    while size < window:
        step = min(size, window - size)
        pair = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    return rank[at] if len(at) else np.zeros(0, np.int64), string


def _bucket(window: int):
    """Covered word ranges of one bucket's documents; for a spread minimiser also its first holders' windows."""

    def run(table: pa.Table) -> pa.Table:
        got = {k: table.column(k).to_pylist() for k in ("spread", "doc_id", "text_key", "first_word", "packed")}
        rank, string = window_ranks(got["packed"], window)
        doc = np.array(got["doc_id"], np.int64)[string]
        begin = np.flatnonzero(np.append(True, string[1:] != string[:-1])) if len(string) else np.zeros(0, np.int64)
        inside = np.arange(len(string)) - np.repeat(begin, np.diff(np.append(begin, len(string))))
        least = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, rank, doc)
        covered = least[rank] < doc
        out: dict[str, list] = {f.name: [] for f in FOUND_ARROW}
        change = np.append(True, (covered[1:] != covered[:-1]) | (string[1:] != string[:-1])) if len(string) else np.zeros(0, bool)
        runs = np.flatnonzero(change)
        stops = np.append(runs[1:], len(string))
        for a, b in zip(runs[covered[runs]], stops[covered[runs]], strict=True):
            s = string[a]
            out["doc_id"].append(got["doc_id"][s])
            out["text_key"].append(got["text_key"][s])
            out["from_word"].append(int(got["first_word"][s] + inside[a]))
            out["to_word"].append(int(got["first_word"][s] + inside[b - 1] + window))
            out["digest"].append(None)
        if got["spread"][0]:
            last, cut = -1, []
            for k in np.flatnonzero(~covered):
                s = string[k]
                if s != last:
                    last, cut = s, got["packed"][s].split(" ")
                i = int(inside[k])
                out["doc_id"].append(got["doc_id"][s])
                out["text_key"].append(got["text_key"][s])
                out["from_word"].append(int(got["first_word"][s]) + i)
                out["to_word"].append(int(got["first_word"][s]) + i + window)
                out["digest"].append(hashlib.sha256(" ".join(cut[i : i + window]).encode()).digest())
        return pa.Table.from_pydict(out, schema=FOUND_ARROW)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave the covered words out and digest what is kept."""
    for batch in batches:
        ids, parts = batch.column(0), batch.column(2).to_pylist()
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = (text or "").encode()
            words = raw.split()
            removed = 0
            if parts[i]:
                keep = np.ones(len(words), bool)
                for x in parts[i]:
                    keep[x["from_word"] : x["to_word"]] = False
                removed = int(len(words) - keep.sum())
                words = [w for w, k in zip(words, keep, strict=True) if k]
            out["n_words"].append(len(words) + removed)
            out["n_removed"].append(removed)
            out["kept"].append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def covered_ranges(docs: DataFrame, window: int = 50, mmer: int = 8, bucket_rows: int = 1024) -> DataFrame:
    """Word ranges (doc_id, text_key, ranges) that an earlier document repeats.

    ``docs`` has doc_id, text_key and text. Texts meet ranges by merge join at every size,
    as either side grows with the input. ``bucket_rows`` bounds the super-k-mers that one
    bucket holds of one minimiser and sizes the buckets.
    """
    parts = materialize(superkmers(docs.where("doc_id is not null"), window, mmer))
    shared = materialize(
        parts.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("minimiser", "n")
    )
    buckets = max(1, -(-int(shared.agg(F.sum("n")).first()[0] or 0) // bucket_rows))
    salts = F.ceil(F.col("n") / bucket_rows)
    moving = (
        parts.join(shared, "minimiser")
        .withColumn("spread", F.col("n") > bucket_rows)
        .withColumn("bucket", F.when(F.col("spread"), F.xxhash64("minimiser", F.pmod(F.xxhash64("doc_id"), salts))).otherwise(F.pmod(F.col("minimiser"), F.lit(buckets))))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("bucket", "spread", "first_word", "n_windows")).alias("parts"))
    )
    packed = docs.join(moving.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "parts").mapInArrow(_pack(window), PACKED)
    found = materialize(packed.groupBy("bucket", "spread").applyInArrow(_bucket(window), FOUND))
    holder = Window.partitionBy("digest")
    over = found.where("digest is not null").withColumn("least", F.min("doc_id").over(holder)).where("least < doc_id")
    ranges = found.where("digest is null").drop("digest").unionByName(over.drop("digest", "least"))
    return ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("from_word", "to_word")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, mmer: int = 8, bucket_rows: int = 1024) -> DataFrame:
    """Documents (doc_id, n_words, n_removed, kept) without words that an earlier document repeats.

    See the module's head for the method and the results on nulls, ties and repeated rows.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))
    ranges = covered_ranges(base, window, mmer, bucket_rows)
    return base.join(ranges.hint("merge"), ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges").mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, mmer: int = 8, bucket_rows: int = 1024) -> DataFrame:
    """``docs`` with the repeated words cut from its text; untouched texts stay as they are.

    Where words go, the rest is joined by one space. All rows and columns stay.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, parts in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            if text is not None and parts:
                words = text.encode().split()
                keep = np.ones(len(words), bool)
                for x in parts:
                    keep[x["from_word"] : x["to_word"]] = False
                text = b" ".join([w for w, k in zip(words, keep, strict=True) if k]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_key", F.xxhash64("text"))
    ranges = covered_ranges(base, window, mmer, bucket_rows).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("ranges").alias("__ranges"))
    joined = docs.join(ranges.hint("merge"), (docs[id_col].cast("long") == ranges["__id"]) & (F.xxhash64(docs[text_col]) == ranges["__key"]), "left")
    return joined.withColumn(text_col, cut(docs[text_col], F.col("__ranges"))).select(*docs.columns)
