"""Quality, toxicity and language-model scores: fixtures, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.test_dedup import SF, table
from tidemark.llm import arrays, masked_lm, quality, queries, toxicity
from tidemark.llm.sampling import fold

BIG = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one"), (4, "one"), (None, "two words"), (5, "x " * 50_000), (6, "é ß ü\n日本"), (7, "\n" * 300)]


def held_out(spark, name, label):
    got = queries.queries()[name](spark, BIG).toPandas()
    labels = spark.read.parquet(f"{BIG}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    both = got.merge(labels, on="doc_id")
    both = both[both["held_out"]]
    return both["predicted"].to_numpy(), both[label].to_numpy(), got


def test_quality_held_out(spark):
    said, true, got = held_out(spark, "op1_quality_crf", "quality")
    assert (said == true).mean() > 0.95
    assert said[true == 1].mean() > 0.97
    crc = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    assert (got["held_out"] == crc).all()
    assert got["score"].between(0, 1).all()


def test_toxicity_held_out(spark):
    said, true, got = held_out(spark, "op8_toxicity_string_kernel", "toxic")
    assert (said == true).mean() > 0.95
    assert said[true == 0].mean() < 0.03 and said[true == 1].mean() > 0.85
    # neither a language nor long texts are judged by other measures
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas()
    clean = got.merge(docs, on="doc_id").merge(spark.read.parquet(f"{BIG}/labels.parquet").where("toxic = 0").select("doc_id").toPandas(), on="doc_id")
    assert clean.groupby("lang")["predicted"].mean().max() < 0.05
    assert clean[clean["n_chars"] > 4000]["predicted"].mean() < 0.05


def test_logistic_of_separable_labels_is_finite_and_falls():
    rng = np.random.default_rng(0)
    x = np.stack([np.append(rng.normal(0, 0.1, 90), rng.normal(2, 0.1, 10)), rng.normal(6, 1, 100)], axis=1)
    y = np.append(np.zeros(90), np.ones(10))
    w = toxicity.logistic(x, y, np.ones(100))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(w).max() < 50 and p[y == 1].min() > 0.8 and p[y == 0].max() < 0.1
    assert 0.05 < p[np.abs(x[:, 0] - 1).argmin()] < 0.95 or np.abs(x[:, 0] - 1).min() > 0.5


def test_scores_equal_the_landmark_machine(spark):
    """The folded table gives every word landmark coefficients times kernel."""
    words = [b"\x1b" + bytes(ord(c) - 96 for c in w) + b"\x1b" for w in ("moron", "mooron", "kind", "thereafter", "mor")]
    landmarks = [words[0], words[2]]
    beta = np.array([1.5, -0.5])
    lw, ln, lv = toxicity._rows(landmarks)
    size = [np.sqrt(sum(np.bincount(ln[lw == k], lv[lw == k]) ** 2)) for k in (0, 1)]
    table = np.zeros(toxicity.N_CODES, np.float32)
    for k, n, v in zip(lw, ln, lv, strict=True):
        table[n] += beta[k] * v / size[k]
    want = toxicity.kernel_rows(words, landmarks) @ beta
    texts = ["".join(chr(c + 96) if c < 27 else " " for c in w) for w in words]
    assert np.allclose(toxicity.decision(pa.array(texts), table)[:, 0], want, atol=1e-4)
    # brute force: all gapped subsequences of four characters inside the words
    assert np.allclose(toxicity.kernel_rows(words, landmarks)[:, 0] * size[0], [plain_kernel(w, landmarks[0]) for w in words], rtol=1e-4)


def plain_kernel(a, b):
    from itertools import combinations

    def space(w):
        out = {}
        for at in combinations(range(len(w)), 4):
            gap = at[3] - at[0] - 3
            if gap <= toxicity.SKIPPED:
                key = tuple(w[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY**gap
        return out

    x, y = space(a), space(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_reject_keeps_odd_rows_and_columns(spark):
    docs = table(spark, ODD).withColumn("score", F.lit(1)).withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    got = toxicity.reject(docs, labels, fold("doc_id", 3) >= 0)
    assert got.columns == docs.columns and got.count() == len(ODD)
    assert toxicity.reject(docs.limit(0), labels, fold("doc_id", 3) >= 0).count() == 0


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows(spark, module, label):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = module.score(docs, known, fold("doc_id", 3) >= 0, label=label).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(docs.limit(0), labels, fold("doc_id", 3) >= 0, label=label).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    node, pair = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    good, _, _ = quality.marginals(node, pair, first)
    for a, b in zip(first[:-1], first[1:]):
        n, total, on = b - a, 0.0, np.zeros(b - a)
        for bits in range(1 << n):
            y = [(bits >> k) & 1 for k in range(n)]
            w = math.exp(sum(node[a + k] * y[k] for k in range(n)) + sum(pair[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            on += w * np.array(y)
        assert np.allclose(good[a:b], on / total)


def test_kernel_matches_definition():
    """Sum over pairs of four-character subsequences with few skips, by enumeration."""
    from itertools import combinations

    def features(word):
        out = {}
        for at in combinations(range(len(word)), 4):
            steps = [b - a for a, b in zip(at, at[1:])]
            if max(steps) <= 3 and sum(steps) <= 3 + toxicity.SKIPPED:
                key = bytes(word[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (sum(steps) - 3)
        return out

    words = [bytes([27, 9, 4, 9, 15, 20, 27]), bytes([27, 9, 4, 24, 9, 15, 20, 27]), bytes([27, 1, 2, 3, 4, 5, 27])]
    got = toxicity.kernel_rows(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = features(a), features(b)
            norm = math.sqrt(sum(v * v for v in fb.values()))
            assert math.isclose(got[i, j], sum(v * fb.get(k, 0) for k, v in fa.items()) / norm, rel_tol=1e-5, abs_tol=1e-6)


def test_gapped_and_inserted_insults():
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9))) for _ in range(400)]
    say = lambda n: list(rng.choice(clean, n))
    texts, label = [], []
    for i in range(600):
        words = say(30)
        if i % 3 == 0:
            words[int(rng.integers(30))] = ["grimblor", "snarvex"][i % 2]
        texts.append(" ".join(words))
        label.append(int(i % 3 == 0))
    model = toxicity.train(texts, np.array(label), np.ones(600))
    probe = lambda w: toxicity.probability(pa.array([" ".join([*say(10), w, *say(10)])]), model)[0]
    for word in ("grimblor", "GRIMBLOR", "gri-mblor", "grixmblor", "g r i m b l o r", "sn4rvex"):
        assert probe(word) > 0.3, word
    assert np.mean([probe("tree") > 0.3 for _ in range(40)]) < 0.1


def test_pseudo_likelihood_by_hand(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog ran " * 30) for i in range(20)] + [(50, "mat dog the the ran on"), (51, None), (51, ""), (None, "cat sat")], "doc_id long, text string")
    model = masked_lm.fit(docs.select("text"), rounds=1)
    net = masked_lm.Network(*model["shape"], model["flat"])
    text = "mat dog the the ran on"
    buf, off = arrays.text_buffer(pa.array([text]))
    bucket, first = masked_lm.buckets(buf, off, len(model["id_of"]).bit_length() - 1)
    ids = model["id_of"][bucket]
    total = 0.0
    for t in range(len(ids)):
        side = [ids[t + k] if 0 <= t + k < len(ids) else net.ids for k in (-2, -1, 1, 2)]
        h = np.tanh(net.parts["shift"] + sum(net.parts["embed"][k][c] for k, c in enumerate(side)))
        a = h @ net.parts["by_class"] + net.parts["class_shift"]
        c = ids[t] // net.per
        b = h @ net.parts["by_id"][c] + net.parts["id_shift"][c]
        total += a[c] - np.log(np.exp(a).sum()) + b[ids[t] % net.per] - np.log(np.exp(b).sum()) + model["inside"][bucket[t]]
    words, got = masked_lm.column_scores(pa.array([text, None]), model)
    assert words.tolist() == [6, 0] and math.isclose(got[0], total, rel_tol=1e-4) and got[1] == 0
    rows = masked_lm.score(docs, rounds=1).collect()
    assert len(rows) == 24 and sum(r["mean_log_likelihood"] is None for r in rows) == 2
    assert masked_lm.score(docs.limit(0)).count() == 0


def test_pseudo_likelihood_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    net = masked_lm.Network(64, 8, 2)
    ids = rng.integers(0, 64, 12)
    context = net.context(ids, np.array([0, 12]))
    every = np.array([net.log_probability(np.full(12, v), context) for v in range(64)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    flat = net.flat.astype(np.float64).copy()
    g = net.gradient(ids, context)
    for k in rng.integers(0, len(flat), 25):
        up, down = flat.astype(np.float32), flat.astype(np.float32)
        up[k] += 1e-2
        down[k] -= 1e-2
        mean = lambda f: masked_lm.Network(64, 8, 2, f).log_probability(ids, context).mean()
        assert abs((mean(up) - mean(down)) / 2e-2 - g[k]) < 2e-3


def test_masked_lm_beats_its_unigram_however_it_is_partitioned(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_masked_lm(spark, sf).toPandas()
    assert len(got) == 1000 and (got["log_likelihood"] <= 0).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counts = masked_lm.bucket_counts(docs)
    assert len(counts) >= 2 * (counts > 0).sum() and counts.sum() == got["n_words"].sum()
    share = (counts + 0.5) / (counts + 0.5).sum()
    unigram = (counts * np.log(share)).sum() / counts.sum()
    assert got["log_likelihood"].sum() / got["n_words"].sum() > unigram + 0.1
    other = masked_lm.score(docs.repartition(11)).toPandas()
    both = got.merge(other, on="doc_id")
    assert len(both) == 1000 and np.allclose(both["log_likelihood_x"], both["log_likelihood_y"], rtol=1e-4)


def test_masked_lm_starts_as_the_unigram_and_shares_sum_to_one():
    counts = np.arange(64) ** 2
    net = masked_lm.Network(64, 8, 2, counts=counts)
    ids = np.arange(64)
    got = np.exp(net.log_probability(ids, net.context(ids, np.array([0, 64]))))
    assert np.allclose(got, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-4)


def test_masked_lm_of_odd_rows(spark):
    docs = table(spark, ODD).withColumn("h", F.lit("x")).withColumn("n_words", F.lit(1)).withColumn("log_likelihood", F.lit(1))
    got = masked_lm.score(docs).collect()
    assert len(got) == len(ODD) and all((r["n_words"] == 0) == (r["mean_log_likelihood"] is None) for r in got)
    assert {r["n_words"] for r in got if r["doc_id"] == 5} == {50_000}


def test_scores_do_not_depend_on_batches():
    texts = pa.array([t for _, t in ODD])
    rows = [arrays.words(*arrays.text_buffer(texts.slice(i, 1))) for i in range(len(ODD))]
    buf, off = arrays.text_buffer(texts)
    starts, ends, first = arrays.words(buf, off)
    assert np.diff(first).tolist() == [len(r[0]) for r in rows]


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
    assert spark.range(1).select(fold("id", 4).alias("f"), F.lit(1)).count() == 1


def test_every_position_teaches(spark):
    words = "a b c d e f g h i j k l m n o p".split()
    swapped = [*words[:8], words[9], words[8], *words[10:]]  # same counts, same neighbours of the first word
    one, two = (masked_lm.fit(spark.createDataFrame([(" ".join(w),)], "text string").coalesce(1), rounds=1)["flat"] for w in (words, swapped))
    assert not np.array_equal(one, two)
