"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each word of a text is predicted from its ``side`` neighbours on both sides; a document's
score is the sum of the conditional log-probabilities of all its words.

Words are hashed to buckets, at least twice as many as the corpus has different words, up to
2**20. Corpus counts of the buckets, over every document, decide which have an id of their
own (the most frequent half of the ids); the rest share the other ids by hash, and an id's
probability divides among its buckets by their counts, so probabilities sum to one over all
buckets. The network sums one embedding per neighbour and position, applies tanh, and
predicts the id in two steps (class of the id, then id within the class). It starts as the
corpus's unigram distribution: output shifts are log counts, output weights are zero.

Training is data-parallel in numpy, one pass over every position of every document in
``rounds`` parts. A part's documents are spread by a hash of their row over shards of about
``shard_words`` words, each trained in the order of that hash, so the weights follow from the
rows and not from how they lie in files. The shards' weights are averaged by position count
in bounded groups; what is gathered grows with the input and no text leaves its task.

Defined results: a null or empty text has no words and log-probability 0; repeated ids keep
a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import materialize, pick

CLASSES = 32
MOST_BITS = 20


def buckets(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, and per row the index of its first word (n+1 long)."""
    starts, ends, first = arrays.words(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), first
    return (arrays.span_hash(buf, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), first


def bucket_counts(docs: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Words of all documents by bucket; tasks count, Spark adds, at most 2**most_bits numbers come back.

    The number of buckets is the power of two that gives every different word two, within the limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << most_bits, np.int64)
        for batch in batches:
            for _, _, buf, off in arrays.slices(batch.column(0)):
                np.add.at(total, buckets(buf, off, most_bits)[0], 1)
        seen = np.flatnonzero(total)
        for a in range(0, len(seen), 1 << 16):
            part = seen[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bits = min(most_bits, max(10, math.ceil(math.log2(max(got.num_rows, 1))) + 1))
    out = np.zeros(1 << bits, np.int64)
    np.add.at(out, got.column("bucket").to_numpy() >> (most_bits - bits), got.column("n").to_numpy())
    return out


class Network:
    """The window network; weights are one flat float32 vector."""

    def __init__(self, ids: int, width: int, side: int, flat: np.ndarray | None = None, seed: int = 7, counts: np.ndarray | None = None):
        self.ids, self.width, self.side = ids, width, side
        self.per = ids // CLASSES
        shapes = {"embed": (2 * side, ids + 1, width), "shift": (width,), "by_class": (width, CLASSES), "class_shift": (CLASSES,), "by_id": (CLASSES, width, self.per), "id_shift": (CLASSES, self.per)}
        sizes = [math.prod(s) for s in shapes.values()]
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat, self.parts = flat, {}
        at = 0
        for (name, shape), size in zip(shapes.items(), sizes, strict=True):
            self.parts[name] = flat[at : at + size].reshape(shape)
            at += size
        if counts is not None:  # the unigram distribution of the ids
            level = np.log(counts.reshape(CLASSES, self.per) + 0.5)
            self.parts["by_class"][:] = self.parts["by_id"][:] = 0
            self.parts["class_shift"][:] = np.log(np.exp(level).sum(axis=1))
            self.parts["id_shift"][:] = level - self.parts["class_shift"][:, None]

    def context(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Neighbours' ids of every position; outside the row the id is ``self.ids``."""
        n = len(ids)
        lo = np.repeat(first[:-1], np.diff(first))
        hi = np.repeat(first[1:], np.diff(first))
        out = np.full((2 * self.side, n), self.ids, np.int32)
        at = np.arange(n)
        for k, step in enumerate([*range(-self.side, 0), *range(1, self.side + 1)]):
            ok = (at + step >= lo) & (at + step < hi)
            out[k, ok] = ids[at[ok] + step]
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.parts["shift"] + self.parts["embed"][0][context[0]]
        for table, ids in zip(self.parts["embed"][1:], context[1:], strict=True):
            h += table[ids]
        return np.tanh(h)

    def by_class(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of positions by class, the classes' cuts in it, and the ids within their class in that order."""
        kind = ids // self.per
        order = np.argsort(kind.astype(np.int16), kind="stable")
        return order, np.searchsorted(kind[order], np.arange(CLASSES + 1)), (ids % self.per)[order]

    def log_probability(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        p = self.parts
        order, cut, inner = self.by_class(ids)
        h = self.hidden(context[:, order])
        logits = h @ p["by_class"] + p["class_shift"]
        found = logits[np.arange(len(ids)), ids[order] // self.per] - _log_sum(logits)
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                logits = h[a:b] @ p["by_id"][c] + p["id_shift"][c]
                found[a:b] += logits[np.arange(b - a), inner[a:b]] - _log_sum(logits)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradient(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Mean gradient of the log-probability, flat."""
        g = Network(self.ids, self.width, self.side, np.zeros_like(self.flat))
        p, q, n = self.parts, g.parts, len(ids)
        order, cut, inner = self.by_class(ids)
        context = context[:, order]
        h = self.hidden(context)
        slope = -_softmax(h @ p["by_class"] + p["class_shift"])
        slope[np.arange(n), ids[order] // self.per] += 1
        q["by_class"] += h.T @ slope
        q["class_shift"] += slope.sum(axis=0)
        back = slope @ p["by_class"].T
        for c in range(CLASSES):
            a, b = cut[c], cut[c + 1]
            if a < b:
                slope = -_softmax(h[a:b] @ p["by_id"][c] + p["id_shift"][c])
                slope[np.arange(b - a), inner[a:b]] += 1
                q["by_id"][c] += h[a:b].T @ slope
                q["id_shift"][c] += slope.sum(axis=0)
                back[a:b] += slope @ p["by_id"][c].T
        back *= 1 - h * h
        q["shift"] += back.sum(axis=0)
        for table, at in zip(q["embed"], context, strict=True):
            order = np.argsort(at.astype(np.int16) if self.ids < 1 << 15 else at, kind="stable")  # short keys sort by radix
            at = at[order]
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            table[at[begin]] = np.add.reduceat(back[order], begin, axis=0)
        return g.flat / n


def _top(x: np.ndarray) -> np.ndarray:
    """What to take from each row before exp: one number while that is exact enough, else its maximum."""
    top = x.max(initial=0)
    return np.full((len(x), 1), top, x.dtype) if top - x.min(initial=0) < 60 else x.max(axis=1, keepdims=True)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - _top(x))
    return e / e.sum(axis=1, keepdims=True)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = _top(x)
    return top[:, 0] + np.log(np.exp(x - top).sum(axis=1))


def train_round(docs: DataFrame, id_of: np.ndarray, flat: np.ndarray, shape: tuple[int, int, int], shards: int, batch_rows: int = 4096, step: float = 0.4, fan: int = 32) -> np.ndarray:
    """One round: shards of ``docs`` (text, spread by ``h``) start from ``flat``, train on every position, and are averaged."""
    bits = len(id_of).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*shape, flat.copy())
        scale = np.full(len(flat), 1e-3, np.float32)
        seen = 0

        def learn(ids: np.ndarray, context: np.ndarray) -> None:
            nonlocal scale
            for a in range(0, len(ids), batch_rows):
                g = net.gradient(ids[a : a + batch_rows], context[:, a : a + batch_rows])
                scale += g * g
                net.flat += step * g / np.sqrt(scale)

        wait: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, buf, off in arrays.slices(batch.column(0)):
                bucket, first = buckets(buf, off, bits)
                if not len(bucket):
                    continue
                ids = id_of[bucket]
                wait.append((ids, net.context(ids, first)))
                seen += len(ids)
                if sum(len(x) for x, _ in wait) >= 8 * batch_rows:
                    learn(np.concatenate([x for x, _ in wait]), np.concatenate([x for _, x in wait], axis=1))
                    wait = []
        if wait:
            learn(np.concatenate([x for x, _ in wait]), np.concatenate([x for _, x in wait], axis=1))
        if seen:
            yield _weights(TaskContext.get().partitionId(), seen, net.flat)

    def _weights(part: int, seen: int, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["part", "seen", "weights"])

    def average(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "seen", "weights")), strict=True), key=lambda r: r[0])
        total = sum(r[1] for r in rows)
        mean = sum(np.frombuffer(r[2], np.float32).astype(np.float64) * (r[1] / total) for r in rows)
        return pa.Table.from_batches([_weights(rows[0][0], total, mean.astype(np.float32))])

    kind = "part long, seen long, weights binary"
    spread = docs.repartition(shards, "h").sortWithinPartitions("h")
    parts = materialize(spread.select("text").mapInArrow(run, kind))
    n = parts.count()
    while n > fan:
        parts = materialize(parts.groupBy((F.col("part") / fan).cast("long").alias("group")).applyInArrow(average, kind).withColumn("part", (F.col("part") / fan).cast("long")))
        n = parts.count()
    rows = parts.toArrow()  # at most ``fan`` rows of one weight vector
    return np.frombuffer(average(rows).column("weights")[0].as_py(), np.float32) if n else flat


def fit(docs: DataFrame, ids: int = 1024, width: int = 8, side: int = 2, rounds: int = 2, shard_words: int = 1 << 20) -> dict:
    """Corpus counts and trained network of ``docs`` (text and any other columns, which spread the rows)."""
    counts = bucket_counts(docs)
    order = np.lexsort((np.arange(len(counts)), -counts))
    own = ids // 2
    id_of = (own + arrays.mix(np.arange(len(counts))) % np.uint64(ids - own)).astype(np.int32)
    id_of[order[:own]] = np.arange(own)
    share = counts + 0.5
    per_id = np.bincount(id_of, share, ids)
    inside = np.log(share / per_id[id_of]).astype(np.float32)
    shape = (ids, width, side)
    # ids of one class lie apart in frequency, so classes weigh about the same
    place = np.arange(ids) % CLASSES * (ids // CLASSES) + np.arange(ids) // CLASSES
    id_of, per_id = place[id_of].astype(np.int32), per_id[np.argsort(place)]
    flat = Network(*shape, counts=per_id).flat
    shards = max(1, math.ceil(int(counts.sum()) / rounds / shard_words))
    rows = docs.select("text", F.xxhash64(*docs.columns).alias("h"))
    for r in range(rounds):
        flat = train_round(rows.where(F.pmod(F.hash("h"), F.lit(rounds)) == r), id_of, flat, shape, shards)
    return {"id_of": id_of, "inside": inside, "flat": flat, "shape": shape, "counts": counts}


def column_scores(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed conditional log-probability of every text."""
    net = Network(*model["shape"], model["flat"])
    words, total = [], []
    for _, _, buf, off in arrays.slices(column, 1 << 19):
        bucket, first = buckets(buf, off, len(model["id_of"]).bit_length() - 1)
        ids = model["id_of"][bucket]
        log = net.log_probability(ids, net.context(ids, first)) + model["inside"][bucket] if len(ids) else np.zeros(0)
        run = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
        words.append(np.diff(first))
        total.append(run[first[1:]] - run[first[:-1]])
    return (np.concatenate(words), np.concatenate(total)) if words else (np.zeros(0, np.int64), np.zeros(0))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood, mean_log_likelihood (null without words)."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(base, **options)
    model = {k: v for k, v in model.items() if k != "counts"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total = column_scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "log_likelihood"])

    out = base.mapInArrow(run, "doc_id long, n_words long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_words"))
