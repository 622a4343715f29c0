"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its node score is linear in its own shape (letters, symbols,
case, word lengths, repetition) and in the shapes of the lines before and after it; a pair
table scores neighbouring labels. A document's quality is the mean of its lines' marginal
probabilities of being good, from forward-backward, weighted by the lines' bytes.

Training uses documents' labels for all their lines, on a bounded sample. Whole texts are
scored. Defined results: a null or empty text, or one of blank lines only, scores as one
empty line with no neighbours; repeated ids keep a row each; without any labels to learn
from every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import pick
from .sampling import labelled_sample

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "stop": b".,;:?'\"()-",
    "mark": b"#&%*$@^~=+_<>/\\|{}[]",
    "shout": b"!",
    "other": bytes(range(128, 256)),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
N_FEATURES = 18


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes of all lines, their bytes, and per row the index of its first line (n+1 long).

    A row without lines gets one empty line.
    """
    starts, ends, first = arrays.lines(buf, off)
    empty = np.flatnonzero(np.diff(first) == 0)
    if len(empty):
        at = first[empty]
        starts, ends = np.insert(starts, at, off[empty]), np.insert(ends, at, off[empty])
        first = first + np.concatenate([[0], np.cumsum(np.diff(first) == 0)])
    size = ends - starts
    n = len(starts)
    share = np.zeros((n, N_FEATURES), np.float32)
    per = np.maximum(size, 1)
    for k, table in enumerate(_TABLES.values()):
        run = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=run[1:], dtype=np.int32)
        share[:, k] = (run[ends] - run[starts]) / per
    share[:, 0] = share[:, 0] / np.maximum(share[:, 0] + share[:, 1] + share[:, 6] / 2, 1e-6)
    ws, we, _ = arrays.words(buf, off)
    line = np.searchsorted(starts, ws, "right") - 1
    count = np.bincount(line, minlength=n)
    words = np.maximum(count, 1)
    length = (we - ws).astype(np.float32)
    add = lambda v: np.bincount(line, weights=v, minlength=n) / words
    share[:, 7] = np.minimum(add(length), 40) / 10
    share[:, 8] = np.log1p(count)
    share[:, 9] = np.log1p(size)
    share[:, 10] = add(length <= 3)
    share[:, 11] = add(length >= 14)
    h = arrays.span_hash(buf, ws, we) if len(ws) else np.zeros(0, np.uint64)
    for k, lag in ((12, 1), (13, 2)):
        same = np.zeros(len(h))
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (line[lag:] == line[:-lag])
        share[:, k] = add(same)
    if len(h):
        last = buf[we - 1]
        share[:, 14] = add(_TABLES["mark"][last] | _TABLES["shout"][last])
        order = np.lexsort((h, line))
        again = np.zeros(len(h))
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
        share[:, 15] = add(again)
        share[:, 16] = np.log1p(add(again) * words)
    lh = arrays.span_hash(buf, starts, ends) if len(buf) else np.zeros(n, np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((lh, row))
    if n > 1:
        same = (lh[order[1:]] == lh[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        share[order[1:], 17] = same
        share[order[:-1], 17] = np.maximum(share[order[:-1], 17], same)
    return share, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own shape, the line before, the line after, and whether there is either, and a constant."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    has = np.ones((n, 2), np.float32)
    before[1:], after[:-1] = x[:-1], x[1:]
    has[first[:-1], 0] = 0
    has[first[1:] - 1, 1] = 0
    before *= has[:, :1]
    after *= has[:, 1:]
    return np.concatenate([x, before, after, has, np.ones((n, 1), np.float32)], axis=1)


def marginals(node: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the summed pair marginals (2x2) and the log partition sum.

    node: score of good against bad. Chains run together, longest first, so step t works on
    those with more than t lines.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]
    trans = np.exp(pair)
    e = np.stack([np.exp(-np.logaddexp(0, node)), np.exp(-np.logaddexp(0, -node))], axis=1)
    base = np.logaddexp(0, node).sum()
    forward = np.empty((len(node), 2))
    scale = np.ones(len(node))
    a = None
    for t, k in enumerate(alive):
        at = begin[:k] + t
        a = e[at] * (1.0 if t == 0 else a[:k] @ trans)
        total = a.sum(axis=1, keepdims=True)
        a = a / total
        forward[at], scale[at] = a, total[:, 0]
    pairs, good = np.zeros((2, 2)), np.empty(len(node))
    b = np.ones((len(size), 2))
    for t in range(len(alive) - 1, -1, -1):
        k, at = alive[t], begin[: alive[t]] + t
        both = forward[at] * b[:k]
        good[at] = both[:, 1] / both.sum(axis=1)
        if t:
            right = e[at] * b[:k] / scale[at][:, None]
            pairs += forward[at - 1].T @ right * trans
            b[:k] = right @ trans.T
    return good, pairs, float(np.log(scale).sum() + base)


def train(features: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> dict[str, np.ndarray]:
    """Maximum-likelihood weights of the field by accelerated gradient ascent.

    features: one line-by-shape matrix per document; its lines all carry the document's label.
    """
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    x = np.concatenate(features).astype(np.float64)
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = with_neighbours(((x - mean) / deviation).astype(np.float32), first).astype(np.float64)
    size = np.diff(first)
    per_line = np.repeat(weights / np.sqrt(size), size)
    y = np.repeat(labels.astype(float), size)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    inside = size - 1
    seen = np.diag([float((inside / np.sqrt(size) * weights)[labels == 0].sum()), float((inside / np.sqrt(size) * weights)[labels == 1].sum())])
    total = per_line.sum()
    for t in range(1, steps + 1):
        good, pairs, _ = marginals(x @ w, pair, first)
        slope = x.T @ (per_line * (y - good)) / total - ridge * w
        table = seen / total - pairs / max(pairs.sum(), 1e-9) * seen.sum() / total - 0.05 * pair
        g = np.concatenate([slope, table.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, pair = w + step[:-4], pair + step[-4:].reshape(2, 2)
    return {"w": w, "pair": pair, "mean": mean, "deviation": deviation}


def score_column(column: pa.Array, model: dict[str, np.ndarray] | None) -> np.ndarray:
    """Quality of every text of an Arrow column."""
    if model is None:
        return np.full(len(column), 0.5)
    out = []
    for _, _, buf, off in arrays.slices(column):
        x, size, first = line_features(buf, off)
        x = with_neighbours(((x - model["mean"]) / model["deviation"]).astype(np.float32), first)
        good, _, _ = marginals((x @ model["w"].astype(np.float32)).astype(np.float64), model["pair"], first)
        weight = np.maximum(size, 1).astype(float)
        out.append(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", per_class: int = 1500, most_bytes: int = 1 << 16) -> dict[str, np.ndarray] | None:
    """Train on at most ``per_class`` documents a label, each of at most ``most_bytes``; tasks make the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, buf, off in arrays.slices(batch.column(1)):
                x, _, first = line_features(buf, off)
                rows += [x[a:b].ravel() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    sample, counts = labelled_sample(docs, labels, label, trains, per_class, most_bytes)
    got = sample.mapInArrow(run, "doc_id long, label int, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    if got["label"].nunique() < 2:
        return None
    y = got["label"].to_numpy()
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return train([np.asarray(v, np.float32).reshape(-1, N_FEATURES) for v in got["x"]], y, weight / weight.mean())


def score(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", **limits) -> DataFrame:
    """(doc_id, score) of every document; learns from labels whose ``doc_id`` fulfils ``trains``."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(base, labels, trains, label, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_column(batch.column(1), model))], names=["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double")
