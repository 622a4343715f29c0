"""Pairwise tree ranker: boosted trees on lambda gradients, all walk-forward folds at once.

The loss of a session is over pairs of its assets: swapping two of them changes the session's
normalised gain (2**relevance - 1, discounted by rank, cut after ``top`` places), and each
pair pulls its two scores apart by that change times the chance of its being misordered. A
pair counts if one of the two stands in the first ``top`` places, as other swaps change nothing.

How a tree grows. Rows lie in blocks of one session each, with their binned features and,
per fold, their scores. One pass finds every session's and fold's first places (block tops, then merged);
one pass a level sums gradients into histograms (fold, node, feature, bin), map-side, and the
driver, which sees only these sums, picks the splits of all folds together. A session of any
size spreads over blocks: its rows meet its first places, never each other. Pairs are
summed as whole numbers of 2**-26, so that trees do not depend on how rows are spread.

Bins are quantiles of each fold's own training rows. Defined results: rows without a feature are
left out; rows without a target teach nothing; a fold without training rows predicts nothing; score ties stand
in the order of a hash of the asset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import stored

LEVELS = 31
UNIT = float(1 << 26)
BLOCK_ROWS = 8192
#: Trees that are applied anew in every pass before scores are written again.
PENDING = 8
BLOCK = "session_index int, n int, bins binary, relevance binary, mask binary, tie binary, score binary"


@dataclass(frozen=True)
class Settings:
    """``regularisation`` is added to a node's curvature; ``least`` rows must lie on each side of a split."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.03
    regularisation: float = 1.0
    least: int = 20
    bins: int = 64
    top: int = 30


@dataclass
class Trees:
    """One tree per fold: split feature (-1: none) and bin of inner nodes, value of all; children of i are 2i+1 and 2i+2."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, folds: int, depth: int) -> Trees:
        inner = 2**depth - 1
        return cls(np.full((folds, inner), -1), np.zeros((folds, inner), int), np.zeros((folds, 2 * inner + 1)))

    def node(self, fold: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each column of ``bins`` (features x rows) has reached after ``levels`` splits."""
        at, every = np.zeros(bins.shape[1], int), np.arange(bins.shape[1])
        for _ in range(levels):
            f = np.where(at < self.feature.shape[1], self.feature[fold, np.minimum(at, self.feature.shape[1] - 1)], -1)
            split = f >= 0
            right = bins[np.maximum(f, 0), every] > self.bin[fold, np.minimum(at, self.bin.shape[1] - 1)]
            at = np.where(split, 2 * at + 1 + right, at)
        return at

    def add(self, fold: int, bins: np.ndarray, scores: np.ndarray) -> None:
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        scores += self.value[fold, self.node(fold, bins, depth)]


def relevance(target: np.ndarray) -> np.ndarray:
    """Ordinal relevance 0 .. 30 of a target in [0, 1]."""
    return np.clip(np.floor(target * (LEVELS - 1)), 0, LEVELS - 1).astype(np.int8)


def ideal(counts: np.ndarray, top: int) -> float:
    """Greatest discounted gain of relevances with these counts."""
    best = np.repeat(np.arange(LEVELS)[::-1], np.minimum(counts[::-1], top))[:top]
    return float(((2.0**best - 1) / np.log2(np.arange(len(best)) + 2)).sum())


def pair_pulls(score: np.ndarray, rel: np.ndarray, place: np.ndarray, top_score: np.ndarray, top_rel: np.ndarray, best: float) -> tuple[np.ndarray, ...]:
    """Gradient and curvature sums in units, of the rows and of the first places, from the pairs between them.

    ``place`` is a row's own place among the first, or their number. A pair of two first places counts with the later one's row.
    """
    top = len(top_score)
    discount = np.append(1 / np.log2(np.arange(top) + 2), 0.0)
    gain = lambda r: 2.0 ** r.astype(float) - 1
    ahead = np.sign(top_rel[:, None].astype(int) - rel)  # 1: the first place should stand higher
    change = np.abs(gain(top_rel)[:, None] - gain(rel)) * np.abs(discount[:top, None] - discount[place]) / best
    change[np.arange(top)[:, None] >= place] = 0
    wrong = 1 / (1 + np.exp(np.clip(ahead * (top_score[:, None] - score), -50, 50)))
    pull = np.rint(ahead * wrong * change * UNIT).astype(np.int64)
    curve = np.rint(wrong * (1 - wrong) * change * UNIT).astype(np.int64)
    return pull.sum(axis=0), curve.sum(axis=0), -pull.sum(axis=1), curve.sum(axis=1)


def best_splits(sums: np.ndarray, level: int, trees: Trees, s: Settings) -> None:
    """Set the splits of one level of all folds from ``sums`` (folds, nodes, features, bins, 3), and their children's values."""
    sums = sums.astype(float)
    sums[..., :2] /= UNIT
    left = sums.cumsum(axis=3)
    whole = left[:, :, :, -1:, :]
    right = whole - left
    worth = lambda x: x[..., 0] ** 2 / (x[..., 1] + s.regularisation)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 2] < s.least) | (right[..., 2] < s.least)] = -np.inf
    value = lambda x: -s.rate * x[0] / (x[1] + s.regularisation)
    base = 2**level - 1
    for fold, node in np.ndindex(gain.shape[:2]):
        if level == 0:
            trees.value[fold, 0] = value(whole[fold, 0, 0, 0])
        f, b = divmod(int(gain[fold, node].argmax()), gain.shape[3])
        if gain[fold, node, f, b] > 1e-12:
            at = base + node
            trees.feature[fold, at], trees.bin[fold, at] = f, b
            trees.value[fold, 2 * at + 1], trees.value[fold, 2 * at + 2] = value(left[fold, node, f, b]), value(right[fold, node, f, b])


@dataclass
class Model:
    """Folds (number, first and last test session), bin edges (fold, feature) and trees of a fit."""

    folds: list[tuple[int, int, int]]
    features: list[str]
    edges: list[list[np.ndarray]]
    trees: list[Trees]
    taught: list[bool]

    def bins(self, fold: int, x: np.ndarray) -> np.ndarray:
        """Features x rows to bins; a bin ends at its edge."""
        return np.stack([np.searchsorted(e, v, "left") for e, v in zip(self.edges[fold], x, strict=True)]).astype(np.uint8)


class _Blocks:
    """Views of a row of BLOCK, with the scores that pending trees give."""

    def __init__(self, row: dict, folds: int, features: int, pending: list[Trees]):
        n = row["n"]
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(folds, features, n)
        self.rel = np.frombuffer(row["relevance"], np.int8)
        self.mask = np.frombuffer(row["mask"], bool).reshape(folds, n)
        self.tie = np.frombuffer(row["tie"], np.int64)
        self.score = np.frombuffer(row["score"], float).reshape(folds, n).copy()
        for trees in pending:
            for fold in range(folds):
                trees.add(fold, self.bins[fold], self.score[fold])


def _first_type(features: int) -> np.dtype:
    return np.dtype([("fold", "i2"), ("score", "f8"), ("tie", "i8"), ("rel", "i1"), ("bins", "u1", (features,))])


def _first(rows: np.ndarray, top: int) -> np.ndarray:
    return rows[np.lexsort((rows["tie"], -rows["score"]))[:top]]


def fit(rows: DataFrame, folds: DataFrame, features: list[str], target: str, embargo: int, settings: Settings = Settings()) -> Model:
    """Fit every fold on its purged training rows (session before the test, label ended before it less the embargo).

    ``rows`` has session_index, label_end, asset, the features and a target in [0, 1]; it is
    read twice. The driver holds the folds, their bin edges, and one level's histograms.
    """
    s, p = settings, len(features)
    spans = sorted((int(f), int(a), int(b)) for f, a, b in folds.select("fold", "test_start", "test_end").collect())
    known = rows.where(" and ".join(f"`{c}` is not null" for c in [*features, target]))
    purged = (F.col("session_index") < F.col("test_start")) & (F.col("label_end") < F.col("test_start") - embargo)
    marks = F.array(*[F.lit(k / s.bins) for k in range(1, s.bins)])
    cuts = known.join(F.broadcast(folds.select("fold", "test_start")), purged).groupBy("fold").agg(*[F.percentile_approx(F.col(c).cast("double"), marks, 10000).alias(f"e{i}") for i, c in enumerate(features)])
    found = {r["fold"]: [np.unique(np.array(r[f"e{i}"])) for i in range(p)] for r in cuts.collect()}
    model = Model(spans, features, [found.get(f, [np.zeros(0)] * p) for f, _, _ in spans], [], [f in found for f, _, _ in spans])
    if not found:
        return model
    blocks = stored(_pack(known, model, target, embargo))
    pending: list[Trees] = []
    for _ in range(s.trees):
        if len(pending) == PENDING:
            blocks = stored(_rescored(blocks, model, pending))
            pending = []
        tops = stored(_tops(blocks, model, pending, s.top))
        trees = Trees.empty(len(spans), s.depth)
        for level in range(s.depth):
            best_splits(_histograms(blocks, tops, model, pending, trees, level, s), level, trees, s)
        model.trees.append(trees)
        pending.append(trees)
    return model


def _pack(known: DataFrame, model: Model, target: str, embargo: int) -> DataFrame:
    """Training rows as blocks of at most about BLOCK_ROWS rows of one session."""
    p, starts = len(model.features), np.array([a for _, a, _ in model.folds])

    def pack(table: pa.Table) -> pa.Table:
        x = [table.column(f"x{i}").to_numpy() for i in range(p)]
        session, end = table.column("session_index").to_numpy(), table.column("label_end").to_numpy()
        mask = (session < starts[:, None]) & (end < starts[:, None] - embargo)
        keep = mask.any(axis=0)
        n = int(keep.sum())
        bins = np.stack([model.bins(f, [v[keep] for v in x]) for f in range(len(starts))])
        out = {
            "session_index": [int(session[0])],
            "n": [n],
            "bins": [bins.tobytes()],
            "relevance": [relevance(table.column("y").to_numpy()[keep]).tobytes()],
            "mask": [np.ascontiguousarray(mask[:, keep]).tobytes()],
            "tie": [table.column("tie").to_numpy()[keep].tobytes()],
            "score": [np.zeros((len(starts), n)).tobytes()],
        }
        return pa.table({k: pa.array(v, pa.int32() if k in ("session_index", "n") else pa.binary()) for k, v in out.items()})

    columns = ["session_index", F.col("label_end").cast("long").alias("label_end"), F.xxhash64("asset").alias("tie"), F.col(target).cast("double").alias("y")]
    slim = known.select(*columns, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.features)])
    sizes = known.groupBy("session_index").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    dealt = slim.join(sizes, "session_index").withColumn("part", F.pmod("tie", "parts"))
    return dealt.groupBy("session_index", "part").applyInArrow(pack, BLOCK)


def _rescored(blocks: DataFrame, model: Model, pending: list[Trees]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [_Blocks(row, len(model.folds), len(model.features), pending).score.tobytes() for row in batch.to_pylist()]
            yield batch.set_column(batch.num_columns - 1, "score", pa.array(scores, pa.binary()))

    return blocks.mapInArrow(run, BLOCK)


def _tops(blocks: DataFrame, model: Model, pending: list[Trees], top: int) -> DataFrame:
    """Per session its first places in every fold, and the folds' ideal gains."""
    folds, p = len(model.folds), len(model.features)
    kind = _first_type(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                b = _Blocks(row, folds, p, pending)
                firsts, counts = [], np.zeros((folds, LEVELS), np.int64)
                for f in range(folds):
                    of = np.flatnonzero(b.mask[f])
                    counts[f] = np.bincount(b.rel[of], minlength=LEVELS)
                    mine = np.empty(len(of), kind)
                    mine["fold"], mine["score"], mine["tie"], mine["rel"], mine["bins"] = f, b.score[f, of], b.tie[of], b.rel[of], b.bins[f][:, of].T
                    firsts.append(_first(mine, top))
                for values, v in zip(out, (row["session_index"], np.concatenate(firsts).tobytes(), counts.tobytes()), strict=True):
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["session_index", "firsts", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(table.column("firsts").to_pylist()), kind)
        counts = sum(np.frombuffer(c, np.int64).reshape(folds, LEVELS) for c in table.column("counts").to_pylist())
        kept = np.concatenate([_first(every[every["fold"] == f], top) for f in range(folds)])
        best = np.array([ideal(c, top) for c in counts])
        return pa.table({"session_index": table.column("session_index").slice(0, 1), "firsts": pa.array([kept.tobytes()], pa.binary()), "best": pa.array([best.tobytes()], pa.binary())})

    return blocks.mapInArrow(run, "session_index int, firsts binary, counts binary").groupBy("session_index").applyInArrow(merge, "session_index int, firsts binary, best binary")


def _histograms(blocks: DataFrame, tops: DataFrame, model: Model, pending: list[Trees], trees: Trees, level: int, s: Settings) -> np.ndarray:
    """Sums of gradient, curvature (in units) and rows: (folds, nodes of the level, features, bins, 3)."""
    folds, p = len(model.folds), len(model.features)
    shape = (folds, 2**level, p, s.bins)
    kind = _first_type(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((int(np.prod(shape)), 3), np.int64)

        def put(fold: int, bins: np.ndarray, *values: np.ndarray) -> None:
            node = trees.node(fold, bins, level) - (2**level - 1)
            on = node >= 0  # others ended on an earlier level
            for i in range(p):
                cell = ((fold * shape[1] + node[on]) * p + i) * s.bins + bins[i, on]
                for k, v in enumerate(values):
                    np.add.at(total[:, k], cell, v[on])

        for batch in batches:
            for row in batch.to_pylist():
                b = _Blocks(row, folds, p, pending)
                firsts, best = np.frombuffer(row["firsts"], kind), np.frombuffer(row["best"], float)
                for f in range(folds):
                    of, first = np.flatnonzero(b.mask[f]), firsts[firsts["fold"] == f]
                    if not len(of):
                        continue
                    place = np.full(len(of), len(first))
                    order = np.argsort(first["tie"])
                    near = np.minimum(np.searchsorted(first["tie"][order], b.tie[of]), len(first) - 1)
                    mine = first["tie"][order][near] == b.tie[of]
                    place[mine] = order[near[mine]]
                    bins, ones = b.bins[f][:, of], np.ones(len(of), np.int64)
                    pulls = [np.zeros_like(ones), np.zeros_like(ones)]
                    if best[f] > 0:
                        pulls = pair_pulls(b.score[f, of], b.rel[of], place, first["score"], first["rel"], best[f])
                        put(f, first["bins"].T, pulls[2], pulls[3])
                    put(f, bins, pulls[0], pulls[1], ones)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(np.ascontiguousarray(total[used, k])) for k in range(3)]], ["cell", "g", "h", "n"])

    cells = blocks.join(tops, "session_index").mapInArrow(run, "cell long, g long, h long, n long")
    sums = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((int(np.prod(shape)), 3), np.int64)
    out[sums.column("cell").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in "ghn"], axis=1)
    return out.reshape(*shape, 3)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of each taught fold's test sessions that have all features, with fold and prediction."""
    spark = rows.sparkSession
    spans = [(k, *span) for k, (span, on) in enumerate(zip(model.folds, model.taught, strict=True)) if on]
    table = spark.createDataFrame(spans, "__k int, fold int, __first int, __last int")
    known = rows.where(" and ".join(f"`{c}` is not null" for c in model.features))
    # one row a fold
    test = known.join(F.broadcast(table), F.col("session_index").between(F.col("__first"), F.col("__last"))).drop("__first", "__last")
    test = test.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(model.features)})
    p, kept = len(model.features), [*rows.columns, "fold"]
    kinds = dict(test.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("__k").to_numpy()
            x = np.stack([batch.column(f"__x{i}").to_numpy() for i in range(p)])
            score = np.zeros(len(k))
            for fold in np.unique(k):
                on = k == fold
                part = np.zeros(int(on.sum()))
                bins = model.bins(fold, x[:, on])
                for trees in model.trees:
                    trees.add(fold, bins, part)
                score[on] = part
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(score)], [*kept, "prediction"])

    return test.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", prediction double")


def rank_folds(rows: DataFrame, folds: DataFrame, features: list[str], target: str, embargo: int, settings: Settings = Settings()) -> DataFrame:
    """Test rows of every fold with the prediction of a ranker fitted on the fold's past. ``rows`` is best a stored table."""
    return predict(rows, fit(rows, folds, features, target, embargo, settings))
