"""Toxicity from a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts shared subsequences of four characters, each weighted by
``decay ** skipped`` for up to two skipped characters, so an insult with a character put in
or left out still shares most of its subsequences. A sentence's unit is a word with its
boundaries; letters are folded, common digit substitutes read as letters, other marks
dropped, and letters spelled one by one ("i d i o t") joined.

Landmarks are training words whose character 4-grams tell labels apart. Kernel rows
against them, whitened by the landmarks' own kernel, are the Nyström features of a linear
squared-hinge machine. Labels belong to documents, so the machine learns by witnesses: a
toxic document is represented by its highest-scoring word, a clean one by its highest few,
and both are chosen anew in a few rounds. As the kernel is a sum over subsequences, the
trained machine folds into one weight per subsequence, and scoring a text is a table
look-up per position: whole texts, no pairs of strings.

A document's score is a logistic function, fitted on a quarter of the sample that the machine
has not seen, of its highest word and the logarithm of its words (a chance match is likelier
among many words; beyond the longest text of that quarter the number no longer counts).
Defined results: a null or empty text has the score of decision value 0; repeated ids keep
a row each; without both labels to learn from every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import pick
from .sampling import labelled_sample

EDGE = 27
SKIPPED = 2
DECAY = 0.6
#: Steps between the four characters and the weight of that pattern.
GAPS = [(d, DECAY ** (sum(d) - 3)) for d in product((1, 2, 3), repeat=3) if sum(d) <= 3 + SKIPPED]
N_CODES = 1 << 20

_FOLD = np.zeros(256, np.uint8)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = _c + 1
for _digit, _letter in zip("013457", "oieast", strict=True):
    _FOLD[ord(_digit)] = ord(_letter) - 96
_FOLD[list(range(0x80, 0xC0))] = 28 + np.arange(64) % 4
_FOLD[arrays.SEPARATOR] = EDGE


def folded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all rows with an edge before and after every word, the edges that begin words, and their rows."""
    n = len(off) - 1
    raw = np.insert(buf, off[:-1], 32)
    begin = off[:-1] + np.arange(n)
    code = _FOLD[raw]
    at = np.flatnonzero(code)
    code = code[at]
    edge = code == EDGE
    keep = np.ones(len(code), bool)
    keep[:-1] = ~(edge[:-1] & edge[1:])  # the last of several edges stays
    at, code = at[keep], code[keep]
    edges = np.flatnonzero(code == EDGE)
    row = np.searchsorted(begin, at[edges], "right") - 1
    size = np.diff(np.append(edges, len(code))) - 1
    same = np.zeros(len(edges), bool)
    same[1:] = row[1:] == row[:-1]
    letters = size == 1
    joined = np.zeros(len(edges), bool)
    joined[1:] = letters[1:] & letters[:-1] & same[1:]
    if joined.any():
        keep = np.ones(len(code), bool)
        keep[edges[joined]] = False
        code = code[keep]
        row = row[~joined]
        edges = np.flatnonzero(code == EDGE)
    return code, edges, row


def subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Per gap pattern, the number of the subsequence that starts at each position, and its weight."""
    pad = np.concatenate([code.astype(np.int32), np.zeros(3 + SKIPPED, np.int32)])
    n = len(code)
    for (a, b, c), weight in GAPS:
        yield ((pad[:n] << 15) | (pad[a : a + n] << 10) | (pad[a + b : a + b + n] << 5) | pad[a + b + c : a + b + c + n]), weight


def decision(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Per text of an Arrow column its highest word value and the logarithm of its words plus one."""
    out = [np.zeros((0, 2))]
    for lo, hi, buf, off in arrays.slices(column, 1 << 20):
        code, edges, row = folded(buf, off)
        value = np.zeros(len(code), np.float32)
        for number, weight in subsequences(code):
            value += np.float32(weight) * table[number]
        best = np.full(hi - lo, -np.inf)
        if len(edges):
            np.maximum.at(best, row, np.add.reduceat(value, edges))
        out.append(np.stack([np.where(np.isfinite(best), best, 0.0), np.log1p(np.bincount(row, minlength=hi - lo))], axis=1))
    return np.concatenate(out)


def _words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of three letters or more (with their edges), and one (document, word) per pair, by document."""
    number: dict[bytes, int] = {}
    docs, held = [], []
    for i, text in enumerate(texts):
        buf = np.frombuffer(text.encode(), np.uint8)
        code, edges, _ = folded(buf, np.array([0, len(buf)]))
        raw, stop = code.tobytes(), [*edges[1:].tolist(), len(code)]
        found = {number.setdefault(raw[a:b] + b"\x1b", len(number)) for a, b in zip(edges.tolist(), stop, strict=True) if b - a > 3}
        docs.append(np.full(len(found), i, np.int32))
        held.append(np.sort(np.fromiter(found, np.int32, len(found))))
    return list(number), np.concatenate(docs), np.concatenate(held)


def _rows(words: list[bytes], number_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all subsequences inside each word (with its edges)."""
    size = np.array([len(w) for w in words])
    gap = 3 + SKIPPED
    code = np.frombuffer(b"".join(w + b"\0" * gap for w in words), np.uint8)
    word = np.repeat(np.arange(len(words)), size + gap)
    found = []
    for number, weight in subsequences(code):
        whole = (number & 31 > 0) & (number >> 15 > 0) & ((number >> 5) & 31 > 0) & ((number >> 10) & 31 > 0)
        if number_of is not None:
            whole &= number_of[number] >= 0
        k = np.flatnonzero(whole)
        found.append((word[k], number[k], np.full(len(k), weight, np.float32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def kernel_rows(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel of every word with every landmark scaled to length one."""
    lw, ln, lv = _rows(landmarks)
    used, index = np.unique(ln, return_inverse=True)
    z = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(z, (index, lw), lv)
    z /= np.linalg.norm(z, axis=0, keepdims=True)
    number_of = np.full(N_CODES, -1, np.int32)
    number_of[used] = np.arange(len(used))
    w, n, v = _rows(words, number_of)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    order = np.argsort(w, kind="stable")
    for a in range(0, len(order), 200_000):
        k = order[a : a + 200_000]
        begin = np.flatnonzero(np.append(True, w[k][1:] != w[k][:-1]))
        out[w[k][begin]] += np.add.reduceat(z[number_of[n[k]]] * v[k][:, None], begin, axis=0)
    return out


def choose_landmarks(words: list[bytes], docs: np.ndarray, word_of: np.ndarray, label: np.ndarray, most: int, least: float = 4.0) -> list[bytes]:
    """Words of toxic documents with the most telling 4-grams not yet covered, then common clean words.

    docs, word_of: document and word of every pair, by document.
    """
    size = np.array([len(w) - 3 for w in words])
    by_word = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    at = np.arange(by_word[-1]) + 3 * np.repeat(np.arange(len(words)), size)
    grams, gram = np.unique(code[at] << 15 | code[at + 1] << 10 | code[at + 2] << 5 | code[at + 3], return_inverse=True)
    gram = gram.astype(np.int32)
    held = np.zeros((2, len(grams)), np.int64)  # documents of each label that hold a gram
    begin = np.searchsorted(docs, np.arange(len(label) + 1))
    for i, kind in enumerate(label):
        own = word_of[begin[i] : begin[i + 1]]
        if len(own):
            held[kind, np.unique(np.concatenate([gram[by_word[w] : by_word[w + 1]] for w in own]))] += 1
    t, c = max(1, (label == 1).sum()), max(1, (label == 0).sum())
    rate = held.sum(axis=0) / (t + c)
    z = (held[1] / t - held[0] / c) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / t + 1 / c))
    top = np.maximum.reduceat(z[gram], by_word[:-1])
    chosen: list[int] = []
    covered = np.zeros(len(grams), bool)
    for i in np.lexsort((np.arange(len(words)), -np.add.reduceat(np.maximum(z[gram] - least + 1, 0), by_word[:-1]), -top)):
        if len(chosen) >= most * 3 // 4 or top[i] < least:
            break
        own = gram[by_word[i] : by_word[i + 1]]
        fresh = own[~covered[own]]
        if len(fresh) and z[fresh].max() >= least:
            chosen.append(int(i))
            covered[own] = True
    have = set(chosen)
    common = np.argsort(-np.bincount(word_of[label[docs] == 0], minlength=len(words)), kind="stable")[: 2 * most]
    chosen += [int(i) for i in common if int(i) not in have][: most - len(chosen)]
    return [words[i] for i in chosen]


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge machine with a constant, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        on = y * (x @ w) < 1
        now = np.linalg.solve(penalty + x[on].T @ (x[on] * c[on, None]), x[on].T @ (y[on] * c[on]))
        if np.allclose(now, w, atol=1e-9):
            break
        w = now
    return w


def _learn(words: list[bytes], chosen: list[bytes], docs: np.ndarray, word_of: np.ndarray, label: np.ndarray, weights: np.ndarray, value: np.ndarray | None, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks' coefficients by witness rounds, and every word's value.

    ``value`` ranks words for the first round; without it the nearest landmark of a toxic
    document does. Clean words once chosen stay.
    """
    own = kernel_rows(chosen, chosen).astype(np.float64)
    norm = np.sqrt(np.maximum(np.diag(own), 1e-9))
    gram = own / norm[:, None]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    k = kernel_rows(words, chosen)
    if value is None:
        value = np.full(len(words), -np.inf)
        for j in range(max(1, len(chosen) * 3 // 4)):
            value = np.maximum(value, k[:, j] / norm[j])
    x, square = k, whiten.astype(np.float32)
    for a in range(0, len(x), 1 << 14):  # in place: one matrix of words by landmarks at a time
        x[a : a + (1 << 14)] = k[a : a + (1 << 14)] @ square
    begin = np.searchsorted(docs, np.arange(len(label)))
    clean: np.ndarray | None = None
    for _ in range(rounds):
        order = np.lexsort((-value[word_of], docs))
        rank = np.arange(len(order)) - begin[docs[order]]
        toxic = order[(rank < 1) & (label[docs[order]] == 1)]
        hard = order[(rank < 4) & (label[docs[order]] == 0)]
        clean = hard if clean is None else np.union1d(clean, hard)
        used = np.concatenate([toxic, clean])
        y = np.where(label[docs[used]] == 1, 1.0, -1.0)
        w = _machine(x[word_of[used]].astype(np.float64), y, weights[docs[used]], ridge)
        value = x @ w[:-1].astype(np.float32) + w[-1]
    return whiten @ w[:-1], value


def train(texts: list[str], label: np.ndarray, weights: np.ndarray, landmarks: int = 96, hard: int = 64, rounds: int = 4, ridge: float = 0.1) -> dict[str, np.ndarray] | None:
    """Subsequence weights and the logistic's slope and constant from labelled texts.

    After a first pass the ``hard`` highest words of clean documents become landmarks too.
    Every fourth text teaches only the logistic, so that it sees values as of new texts.
    """
    later = np.arange(len(texts)) % 4 == 3
    if min((label[~later] == 1).sum(), (label[later] == 1).sum(), (label[later] == 0).sum()) < 5:
        later[:] = False
    every, target, mass = texts, label.astype(float), weights
    texts, label, weights = [t for t, k in zip(texts, later, strict=True) if not k], label[~later], weights[~later]
    words, docs, word_of = _words(texts)
    chosen = choose_landmarks(words, docs, word_of, label, landmarks)
    if not chosen:
        return None
    _, value = _learn(words, chosen, docs, word_of, label, weights, None, rounds, ridge)
    clean = np.unique(word_of[label[docs] == 0])
    have = set(chosen)
    chosen += [words[i] for i in clean[np.argsort(-value[clean], kind="stable")] if words[i] not in have][:hard]
    # the second pass chooses among each document's highest words
    order = np.lexsort((-value[word_of], docs))
    top = order[np.arange(len(order)) - np.searchsorted(docs, np.arange(len(label)))[docs[order]] < 16]
    some, held = np.unique(word_of[top], return_inverse=True)
    words, value = [words[i] for i in some], value[some]
    docs, word_of = docs[top], held
    beta, value = _learn(words, chosen, docs, word_of, label, weights, value, rounds, ridge)
    lw, ln, lv = _rows(chosen)
    used, at = np.unique(ln, return_inverse=True)
    z = np.zeros((len(used), len(chosen)))
    np.add.at(z, (at, lw), lv)
    z /= np.linalg.norm(z, axis=0, keepdims=True)
    table = np.zeros(N_CODES, np.float32)
    table[used] = z @ beta
    judged = later if later.any() else ~later
    top, target, mass = decision(pa.array(every, pa.string()), table)[judged], target[judged], mass[judged]
    return {"table": table, "logistic": logistic(top, target, mass), "longest": top[:, 1].max()}


def logistic(x: np.ndarray, label: np.ndarray, mass: np.ndarray, prior: float = 0.02) -> np.ndarray:
    """Weights and constant of the label's probability as a logistic of the columns of ``x``.

    Targets are smoothed by one row a label, the weights of the standardised columns have a
    Gaussian prior, and a Newton step is halved until the objective does not rise, so
    separable labels give finite weights.
    """
    rows = np.array([(label == 0).sum(), (label == 1).sum()])
    goal = np.where(label == 1, (rows[1] + 1) / (rows[1] + 2), 1 / (rows[0] + 2))
    middle, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([(x - middle) / spread, np.ones((len(x), 1))], axis=1)
    ridge = np.append(np.full(x.shape[1], prior), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float((mass * (np.logaddexp(0, z @ w) - goal * (z @ w))).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (mass * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (mass * (p - goal)) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(step).max() < 1e-9:
            break
        w = w - size * step
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())


def probability(column: pa.Array, model: dict[str, np.ndarray] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    x, w = decision(column, model["table"]), model["logistic"]
    x[:, 1] = np.minimum(x[:, 1], model["longest"])  # longer than any text it learned from: no extrapolation
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "toxic", per_class: int = 1200, most_bytes: int = 1 << 13) -> dict[str, np.ndarray] | None:
    """Train on at most ``per_class`` documents a label, each of at most ``most_bytes``."""
    sample, counts = labelled_sample(docs, labels, label, trains, per_class, most_bytes)
    got = sample.toPandas().sort_values(["doc_id", "text"], kind="stable")
    if got["label"].nunique() < 2:
        return None
    y = got["label"].to_numpy()
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return train(got["text"].tolist(), y, weight / weight.mean())


def score(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", **limits) -> DataFrame:
    """(doc_id, score) of every document; learns from labels whose ``doc_id`` fulfils ``trains``."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(base, labels, trains, label, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(batch.column(1), model))], names=["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, trains: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", **limits) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``; columns stay, nothing is shuffled."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(base, labels, trains, label, **limits)

    @F.arrow_udf("double")
    def value(texts: pa.Array) -> pa.Array:
        return pa.array(probability(texts, model))

    return docs.where(value(docs[text_col]) < threshold)
