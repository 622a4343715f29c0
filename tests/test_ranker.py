"""The pairwise tree ranker against a plain version, squared loss and a planted order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.operators import folds, ranker

SMALL = ranker.Settings(trees=4, depth=3, rate=0.2, regularisation=0.5, least=5, bins=16, top=6)


def panel(sessions=40, assets=25, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(1, sessions + 1):
        x = rng.normal(size=(assets, 3))
        worth = np.where(np.abs(x[:, 0]) < 0.6, 2.0, 0.0) + np.where(x[:, 1] > 0.5, x[:, 2], -x[:, 2]) + rng.normal(0, 0.3, assets)
        rank = np.argsort(np.argsort(worth)) / (assets - 1)
        rows += [(t, t + 1, f"a{k}", *map(float, x[k]), float(rank[k])) for k in range(assets)]
    return rows


SCHEMA = "session_index int, label_end int, asset string, x double, y double, z double, target double"


def plain_fold(frame, test_start, embargo, s):
    """Edges and trees of one fold, pair by pair."""
    train = frame[(frame.session_index < test_start) & (frame.label_end < test_start - embargo)]
    x = train[["x", "y", "z"]].to_numpy().T
    n = len(train)
    edges = [np.unique(np.sort(v)[[int(np.ceil(k / s.bins * n)) - 1 for k in range(1, s.bins)]]) for v in x]
    bins = np.array([[(e < v).sum() for v in row] for e, row in zip(edges, x)])
    rel = np.floor(train.target.to_numpy() * 30).astype(int)
    session, tie = train.session_index.to_numpy(), train.tie.to_numpy()
    score, trees = np.zeros(n), []
    for _ in range(s.trees):
        g, h = np.zeros(n), np.zeros(n)
        for t in np.unique(session):
            of = np.flatnonzero(session == t)
            order = sorted(of, key=lambda i: (-score[i], tie[i]))
            best = sum((2.0**r - 1) / np.log2(k + 2) for k, r in enumerate(sorted(rel[of], reverse=True)[: s.top]))
            disc = {i: 1 / np.log2(k + 2) if k < s.top else 0.0 for k, i in enumerate(order)}
            for i in of:
                for j in of:
                    if rel[i] > rel[j] and best > 0:
                        change = (2.0 ** rel[i] - 2.0 ** rel[j]) * abs(disc[i] - disc[j]) / best
                        p = 1 / (1 + np.exp(score[i] - score[j]))
                        g[i] -= p * change
                        g[j] += p * change
                        h[i] += p * (1 - p) * change
                        h[j] += p * (1 - p) * change
        tree = {}

        def grow(at, rows, level):
            value = lambda r: -s.rate * g[r].sum() / (h[r].sum() + s.regularisation)
            tree[at] = (None, None, value(rows))
            if level == s.depth:
                return
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.regularisation)
            top = (1e-12, None, None)
            for f in range(3):
                for b in range(s.bins):
                    left, right = rows[bins[f, rows] <= b], rows[bins[f, rows] > b]
                    if len(left) >= s.least and len(right) >= s.least:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > top[0] + 1e-9:
                            top = (gain, f, b)
            if top[1] is not None:
                tree[at] = (top[1], top[2], tree[at][2])
                grow(2 * at + 1, rows[bins[top[1], rows] <= top[2]], level + 1)
                grow(2 * at + 2, rows[bins[top[1], rows] > top[2]], level + 1)

        grow(0, np.arange(n), 0)
        trees.append(tree)
        score += [walk(tree, bins[:, i]) for i in range(n)]
    return edges, trees


def walk(tree, bins):
    at = 0
    while tree[at][0] is not None:
        at = 2 * at + 1 + (bins[tree[at][0]] > tree[at][1])
    return tree[at][2]


def with_ties(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df, df.withColumn("tie", F.xxhash64("asset")).toPandas()


def test_fit_equals_the_plain_version(spark, monkeypatch):
    """Two folds at once, small blocks and few pending trees, against pair loops."""
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 10)
    monkeypatch.setattr(ranker, "PENDING", 2)
    df, frame = with_ties(spark, panel(18, 14))
    f = folds.evaluator_folds(spark, 18, 8, 4, 1, 1)
    got = ranker.rank_folds(df, f, ["x", "y", "z"], "target", 1, SMALL).toPandas()
    spans = f.orderBy("fold").collect()
    assert len(spans) == 2 and set(got.fold) == {0, 1}
    for fold, first, last in spans:
        edges, trees = plain_fold(frame, first, 1, SMALL)
        test = frame[frame.session_index.between(first, last)]
        true = {}
        for r in test.itertuples():
            bins = [(e < v).sum() for e, v in zip(edges, (r.x, r.y, r.z))]
            true[r.session_index, r.asset] = sum(walk(t, bins) for t in trees)
        mine = {(r.session_index, r.asset): r.prediction for r in got[got.fold == fold].itertuples()}
        assert mine.keys() == true.keys() and len(set(np.round(list(true.values()), 9))) > 5
        assert max(abs(mine[k] - true[k]) for k in true) < 1e-5


def test_blocks_do_not_show(spark, monkeypatch):
    df, _ = with_ties(spark, panel(20, 30))
    f = folds.evaluator_folds(spark, 20, 10, 5, 1, 1)
    fit = lambda d: sorted((r.session_index, r.asset, r.prediction) for r in ranker.rank_folds(d, f, ["x", "y", "z"], "target", 1, SMALL).collect())
    one = fit(df)
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 4)
    assert fit(df.repartition(7)) == one


def ndcg(frame, top):
    out = []
    for _, g in frame.groupby("session_index"):
        gain = 2.0 ** np.floor(g.target * 30) - 1
        place = 1 / np.log2(np.arange(min(top, len(g))) + 2)
        out.append((gain.to_numpy()[np.argsort(-g.prediction.to_numpy())[:top]] * place).sum() / (np.sort(gain)[::-1][:top] * place).sum())
    return np.mean(out)


def test_beats_squared_loss_on_a_planted_order(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.createDataFrame(panel(60, 40, 3), SCHEMA).repartition(4).cache()
    f = folds.evaluator_folds(spark, 60, 30, 40, 1, 1)
    s = ranker.Settings(trees=20, rate=0.3, regularisation=0.1, top=10)
    got = ranker.rank_folds(df, f, ["x", "y", "z"], "target", 1, s).toPandas()
    ready = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features")
    first = f.first()["test_start"]
    model = GBTRegressor(labelCol="target", maxDepth=3, maxIter=20, stepSize=0.3, seed=7).fit(ready.transform(df.where(F.col("label_end") < first - 1)))
    squared = model.transform(ready.transform(df.where(F.col("session_index") >= first))).toPandas()
    assert len(got) == len(squared)
    assert ndcg(got, 10) > max(ndcg(squared, 10), 0.5)


def test_learns_only_from_the_past_and_takes_odd_rows(spark):
    rows = panel(24, 12)
    f = folds.evaluator_folds(spark, 24, 8, 6, 1, 1)
    fit = lambda r: ranker.rank_folds(spark.createDataFrame(r, SCHEMA), f, ["x", "y"], "target", 1, SMALL).orderBy("session_index", "asset").toPandas()
    got = fit(rows)
    changed = fit([(*r[:6], 1 - r[6]) if r[0] >= 12 else r for r in rows])
    pd.testing.assert_frame_equal(got[got.fold == 0].drop(columns="target"), changed[changed.fold == 0].drop(columns="target"))
    odd = fit([(r[0], r[1], r[2], None if k % 17 == 0 else r[3], *r[4:6], None if k % 5 == 0 else 0.5 if r[0] == 3 else r[6]) for k, r in enumerate(rows)])
    assert len(odd) == sum(1 for k, r in enumerate(rows) if k % 17 and r[0] >= got.session_index.min())
    assert np.isfinite(odd.prediction).all()
    none = spark.createDataFrame([], SCHEMA)
    assert ranker.rank_folds(none, f, ["x", "y"], "target", 1, SMALL).count() == 0


@pytest.mark.parametrize("top", [2, 50])
def test_pulls_of_pairs(top):
    """Sums of the pairs between all rows equal a double loop, whatever the cut."""
    rng = np.random.default_rng(1)
    n = 9
    score, rel = rng.normal(size=n), rng.integers(0, 4, n).astype(np.int8)
    order = np.argsort(-score)
    place = np.full(n, min(top, n))
    place[order[:top]] = np.arange(min(top, n))
    best = ranker.ideal(np.bincount(rel, minlength=31), top)
    g, h, tg, th = ranker.pair_pulls(score, rel, place, score[order[:top]], rel[order[:top]], best)
    for i, k in enumerate(order[:top]):
        g[k] += tg[i]
        h[k] += th[i]
    disc = np.where(place < top, 1 / np.log2(place + 2), 0)
    for i in range(n):
        eg = eh = 0.0
        for j in range(n):
            if rel[i] != rel[j]:
                change = abs(2.0 ** rel[i] - 2.0 ** rel[j]) * abs(disc[i] - disc[j]) / best
                sign = 1 if rel[i] > rel[j] else -1
                p = 1 / (1 + np.exp(sign * (score[i] - score[j])))
                eg -= sign * p * change
                eh += p * (1 - p) * change
        assert abs(g[i] / ranker.UNIT - eg) < 1e-6 and abs(h[i] / ranker.UNIT - eh) < 1e-6
