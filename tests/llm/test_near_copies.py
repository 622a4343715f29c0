"""The pipeline's near-duplicate stage against exact Jaccard similarity on five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.test_dedup import table
from tidemark.llm import near_copies


def exact_groups(rows, similarity=0.8):
    """Smallest id of each id's component, over all pairs."""
    sets = []
    for i, text in rows:
        w = (text or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, find(i)) for i in root}


def planted():
    rnd = random.Random(3)
    say = lambda n: [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(n)]
    rows, at = [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "one three")], 10
    for copies in (1, 1, 1, 2, 3, 60):  # the last group is longer than a bucket whose pairs are all made
        base = say(200)
        rows.append((at, " ".join(base)))
        for k in range(copies):
            new = list(base)
            for p in rnd.sample(range(200), rnd.choice([1, 2, 4, 4])):
                new[p] = f"new{at}x{k}x{p}"
            rows.append((at + k + 1, " ".join(new)))
        far = list(base)  # about 0.6: stays
        for p in range(5, 200, 18):
            far[p] = f"far{at}x{p}"
        rows.append((at + 900, " ".join(far)))
        at += 1000
    return rows


@pytest.mark.parametrize("bucket_rows", [512, 7])
def test_planted_copies(spark, bucket_rows):
    rows = planted()
    got = near_copies.near_groups(table(spark, rows), bucket_rows=bucket_rows)
    assert {tuple(r) for r in got.collect()} == exact_groups(rows)


def test_stage_finds_pairs_that_simhash_misses(spark):
    rows = planted()
    kept = corpus_pipeline.near_duplicates(spark, table(spark, [*rows, (None, rows[6][1])]), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in exact_groups(rows) if i == c} | {None}
    assert near_copies.near_groups(table(spark, [])).count() == 0


@pytest.mark.parametrize("size", [4, 9, 200])
def test_similar_texts_share_a_block_of_the_wide_simhash(size):
    """Pairs of Jaccard 0.8 meet on blocks of SimHash bits and pass the radius on its first words; a text's repeats count once."""
    rng = np.random.default_rng(size)
    bits, blocks = near_copies.block_sizes(2000)
    pairs = 2000
    held = rng.integers(0, 1 << 64, (pairs, size + size // 4), np.uint64)
    begin = lambda n: np.arange(pairs + 1) * n
    a = near_copies.wide_hashes(held[:, :size].ravel(), begin(size), 8)
    b = near_copies.wide_hashes(held.ravel(), begin(held.shape[1]), 8)
    assert (near_copies.wide_hashes(np.repeat(held, 2, axis=1).ravel(), begin(2 * held.shape[1]), 8) == b).all()
    meet = (near_copies.block_keys(a, bits, blocks) == near_copies.block_keys(b, bits, blocks)).any(axis=1)
    near = np.bitwise_count(a[:, :2] ^ b[:, :2]).sum(axis=1, dtype=int) <= 38
    assert (meet & near).mean() > 0.99


def test_crowds_of_several_components(spark):
    """Rows with many candidates of too little similarity: the checked tree is not enough, their texts are walked."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(70):
        new = list(base)
        for p in rnd.sample(range(100), rnd.choice([1, 2, 3, 4, 5])):
            new[p] = f"new{i}x{p}"
        rows.append((i, " ".join(new)))
    want = exact_groups(rows)
    assert 1 < len({c for _, c in want}) < 70
    for radius in (38, 60):
        assert {tuple(r) for r in near_copies.near_groups(table(spark, rows), radius=radius).collect()} == want


def test_a_group_is_walked_once_not_once_a_block(spark):
    """Crowds of many blocks that share rows become one, or chunk pairs that hold every pair of its rows."""
    rnd = random.Random(5)
    rows = [(crowd, node) for crowd in range(1, 41) for node in sorted(rnd.sample(range(50), 30))] + [(99, 70), (99, 71)]
    table_ = spark.createDataFrame([(c, n, min(m for d, m in rows if d == c)) for c, n in rows], "crowd long, node long, least long")
    for most in (64, 16):
        crowds = {}
        for r in near_copies._merged(table_, most).collect():
            crowds.setdefault((r["least"], r["crowd"]), set()).add(r["node"])
        assert sum(len(x) for x in crowds.values()) <= 50 * max(1, 2 * 50 // most) + 2
        for i in range(50):
            assert all(any({i, j} <= x for x in crowds.values()) for j in range(i))
        assert {70, 71} in crowds.values()
    assert {(r["crowd"], r["node"]) for r in near_copies._merged(table_.where("crowd < 3"), 2).collect()} == {x for x in rows if x[0] < 3}


def test_a_bucket_names_each_row_of_a_crowd_once_and_no_walked_or_unfit_pairs():
    """Near copies give one row each, with the link to their tree; rows of few candidates give pairs."""
    import pandas as pd

    fp = np.zeros((63, 2), np.int64)
    fp[40, 0], fp[41, 1] = 7, 1 << 20  # near the others
    fp[60:] = -1  # three rows of their own
    nodes = np.arange(63) - 20
    frame = pd.DataFrame({"block": 1, "key": 2, "cell": 0, "node": nodes, "one": fp[:, 0], "two": fp[:, 1], "size": 80, "walked": nodes})
    search = lambda x: pd.concat(near_copies._search(38, 0.8)(iter([x[:50], x[50:]])))
    ends = lambda x: {tuple(sorted(p)) for p in x[["u", "v"]].to_numpy().tolist() if p[0] != p[1]}
    got = search(frame)
    crowd, pairs = got[got["crowd"] != 0], got[got["crowd"] == 0]
    assert sorted(crowd["u"]) == list(range(-20, 40)) and crowd["crowd"].nunique() == 1
    assert (crowd["u"] == crowd["v"]).sum() == 1 and set(crowd["bits"]) <= {0, 1, 3, 4}
    assert ends(pairs) == {(40, 41), (40, 42), (41, 42)} and set(pairs["bits"]) == {-1}
    one = np.where(nodes < 40, -20, nodes)
    assert ends(search(frame.assign(walked=one))) == {(40, 41), (40, 42), (41, 42)}
    assert ends(search(frame.assign(walked=np.where(nodes == 0, 0, one)))) >= {tuple(sorted((0, i))) for i in range(-20, 40) if i}
    # 80 shingles may share eight tenths with 100, not with 101
    assert ends(search(frame[60:].assign(size=[80, 100, 101]))) == {(40, 41), (41, 42)}
