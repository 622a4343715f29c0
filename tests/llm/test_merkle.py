"""Merkle manifest and multiproofs against a plain tree."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_models import ODD
from tidemark.llm import merkle, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels of one tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out += [d for k, d in enumerate(level[run : run + 8], run) if k != i]
        i //= 8
    return out


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows."""
    scopes = {}
    for r in rows:
        lowered = None
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            text = r[4] if r[4] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            lowered = h(*map(framed, (*r[:4], text)))
        leaf = h(*map(framed, r))
        scopes.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, lowered or leaf))
    names = sorted(scopes, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        scopes[s].sort()
        trees[s] = tree([x[2] for x in scopes[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (known, doc_id, leaf, claimed) in enumerate(scopes[s]):
            proof = "".join(siblings(trees[s], i) + siblings(top, k))
            folded = merkle.fold_one(claimed, proof, i, len(scopes[s]), k, len(names))
            out.append((doc_id if known else None, leaf, trees[s][-1][0], top[-1][0], h(proof), folded, claimed == leaf))
            assert merkle.fold_one(leaf, proof, i, len(scopes[s]), k, len(names)) == top[-1][0]
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, idx string, scope string"


def run(spark, rows, tmp_path, parts=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).select(*COLUMNS).collect()]


key = lambda r: (r[0] is None, r[0] or 0, r[1:])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, d).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(plain(rows))
    changed = sum(r[0] % 1 == 0 and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None and any("A" <= c <= "Z" for c in r[4]) for r in rows)
    assert sum(not r[6] for r in got) == changed > 100


def test_odd_rows(spark, tmp_path):
    rows = [(i, "s", [None, "", "en", "é", "zz"][k % 5], None if k % 3 else k, t) for k, (i, t) in enumerate(ODD)]
    rows += [(None, None, None, None, None), (None, "A", "only", 1, "B"), (3, "s", "en", 1, "Twin A"), (3, "s", "en", 1, "Twin A"), (3, "s", "en", 1, "Twin B")]
    assert sorted(run(spark, rows, tmp_path), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 73])
def test_one_scope(spark, tmp_path, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert sorted(run(spark, rows, tmp_path)) == sorted(plain(rows))


@pytest.mark.parametrize("rise", [1, 2])
def test_subtrees_smaller_than_scopes_and_many_scopes(spark, tmp_path, monkeypatch, rise):
    """With small subtrees the levels above them, the last ragged run and fetched nodes all take part."""
    monkeypatch.setattr(merkle, "RISE", rise)
    rows = [(i, None, f"l{i % 11}" if i % 3 else "big", i, f"Text {i}") for i in range(700)]
    assert sorted(run(spark, rows, tmp_path)) == sorted(plain(rows))


def test_proofs_of_some_rows(spark, monkeypatch):
    """A subset of leaves gets the same proofs, and its runs fetch no node that their own leaves give."""
    monkeypatch.setattr(merkle, "RISE", 2)
    docs = spark.createDataFrame([(i, "ab"[i % 7 == 0], i) for i in range(600)], "doc_id long, lang string, v int")
    m = merkle.build(docs, merkle.leaf(F.col("doc_id"), F.col("v")))
    every = {r.doc_id: r.proof for r in merkle.prove(m).collect()}
    some = {r.doc_id: r.proof for r in merkle.prove(m, m.leaves.where("doc_id % 13 = 2 or doc_id between 100 and 140")).collect()}
    assert len(some) > 80 and all(every[i] == p for i, p in some.items())


def test_missing_is_the_least_union():
    rng = np.random.default_rng(2)
    for n in (1, 5, 8, 9, 64, 65, 1000):
        for _ in range(10):
            places = rng.choice(n, rng.integers(1, min(n, 40) + 1), replace=False)
            levels, idx = merkle.missing(places, n)
            got = set(zip(levels.tolist(), idx.tolist()))
            have, true, size, up = {int(p) for p in places}, set(), n, 0
            while size > 1:
                need = {c for p in have for c in range(p // 8 * 8, min(size, p // 8 * 8 + 8))}
                true |= {(up, c) for c in need - have}
                have, size, up = {p // 8 for p in have}, -(-size // 8), up + 1
            assert got == true and len(levels) == len(got)
