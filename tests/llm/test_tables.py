"""Nearest neighbours, token counts, media, packing and mixing against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tests.llm.test_dedup import SF, key, table
from tests.llm.test_models import ODD
from tidemark.llm import media, mixing, packing, permutation_ann, queries, substring_dedup, token_spans
from tidemark.llm.tokens import encoder

RANKS = path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_ids_equal_the_tokenizers_library(spark, tokenizer):
    texts = [t for _, t in documents(spark)] + [t for _, t in ODD[:-2]] + ["a  b \n\n c", " lead", "trail ", "<|endoftext|> it's", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x<|endoftext|", "<|endoftext|", "x\u0085y　z", "\x1c\x1d", "🙂é́"]
    got = encoder(RANKS, PATTERN).ids(texts)
    assert all(g.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    got = queries.op3_permutation_ann(spark, d).toPandas()
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=float)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        near = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        near[ids == q] = np.inf
        true = {ids[i]: near[i] for i in np.lexsort((ids, near))[:10]}
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert all(math.isclose(s, near[ids == i][0], rel_tol=1e-12) for i, s in zip(mine["vec_id"], mine["score"]))
        assert mine["score"].is_monotonic_increasing
        hits += len(set(mine["vec_id"]) & set(true))
        total += 10
    assert hits / total >= 0.9


def test_footrule_by_definition():
    rng = np.random.default_rng(0)
    full = np.array([rng.permutation(12) for _ in range(40)])
    order = full[:, :5].astype(np.int16)
    place = lambda o: [list(o).index(p) if p in o else 5 for p in range(12)]
    want = [[sum(abs(a - b) for a, b in zip(place(q), place(o))) for o in order] for q in order]
    got = np.array([permutation_ann.footrules(permutation_ann.inverted(order, 12, 5), q, 5) for q in order])
    assert (got - got.min(axis=1, keepdims=True) == np.array(want)).all()


def test_ann_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "x") for i in range(300)]
    rows += [(400, None, "x"), (500, [0.0] * 4, "x"), (600, [1.0, None, 0.0, 0.0], "x"), (700, [float("nan"), 1.0, 0.0, 0.0], "x"), (800, [float("inf"), 1.0, 0.0, 0.0], "x"), (900, [1.0, 2.0], "x"), (None, [1.0] * 4, "x")]
    rows += [(1000 + i, rows[100][1], "x") for i in range(30)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    got = permutation_ann.search(table_, F.col("vec_id") % 100 == 0, shard_rows=64, block_rows=2).toPandas()
    assert set(got["query_id"]) == {0, 100, 200, 1000}
    mine = got[got["query_id"] == 100].sort_values("rank")
    assert mine["vec_id"].tolist() == list(range(1000, 1010)) and (mine["score"] == 0).all()
    twice = spark.createDataFrame([(100, [0.5] * 4, "x"), *rows[:120]], "vec_id long, embedding array<double>, shard string")
    both = permutation_ann.search(twice, F.col("vec_id") % 100 == 0).where("query_id = 100").collect()
    assert [r["rank"] for r in sorted(both, key=lambda r: (r["score"], r["vec_id"]))] == list(range(1, 11)) and all(r["vec_id"] != 100 for r in both)
    few = permutation_ann.search(table_.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 2
    assert permutation_ann.search(table_.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "split"])
def test_token_sections(spark, tokenizer, rule):
    rows = documents(spark)[:40] + ODD
    got = token_spans.count_sections(table(spark, rows), RANKS, PATTERN, rule=rule).collect()
    want = []
    for i, text in rows:
        text = text or ""
        ends = np.cumsum([len((x + "\n").encode()) for x in text.split("\n")])
        ends[-1] -= 1
        counts, at = [0.0] * len(ends), 0
        for token in tokenizer.encode(text, add_special_tokens=False).ids:
            size = len(tokenizer.id_to_token(token))
            bytes_in = Counter(int(np.searchsorted(ends, b, "right")) for b in range(at, at + size))
            if rule == "split":
                for s, n in bytes_in.items():
                    counts[s] += n / size
            else:
                counts[min(bytes_in) if rule == "first" else max(bytes_in)] += 1
            at += size
        want += [(i, s, round(c, 6)) for s, c in enumerate(counts)]
        assert ends[-1] == len(text.encode())
    assert key((r["doc_id"], r["section"], round(r["n_tokens"], 6)) for r in got) == key(want)
    for r in got[:50]:
        text = dict(rows[:40]).get(r["doc_id"])
        if text:
            assert text.split("\n")[r["section"]] == text[r["first_char"] : r["end_char"]].removesuffix("\n")


def test_media_round_trip(spark):
    rows = documents(spark)
    got = {r["doc_id"]: r for r in queries.op7_media_columns(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = text.encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        form = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())


def test_media_odd_rows(spark):
    stored = media.texts_as_media(table(spark, ODD))
    out = media.resolve(media.sequences(stored), stored).collect()
    assert len(out) == len(ODD) and all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in out)
    none = media.texts_as_media(table(spark, []))
    assert media.resolve(media.sequences(none), none).count() == 0


def test_interleaved_parts():
    html = '<p>A &amp; b</p><script>no()</script><figure><img src="media:d1" alt="x"><figcaption>One</figcaption></figure>tail<img src="media:d2" alt="two">'
    got = media.parts(html)
    assert [(p["position"], p["kind"], p["text"], p["digest"], p["caption"]) for p in got] == [(0, "text", "A & b", None, None), (1, "media", None, "d1", "One"), (2, "text", "tail", None, None), (3, "media", None, "d2", "two")]
    assert media.parts(None) == [] and media.parts("") == []
    said = lambda html: [(p["text"], p["digest"], p["caption"]) for p in media.parts(html)]
    image = '<img src="media:a">'
    assert said(f"<figure>{image}<figcaption>cap</figure><p>text</p><p>more</p>") == [(None, "a", "cap"), ("text", None, None), ("more", None, None)]
    assert said("<figure><p>in</p><figcaption>lone <b>cap</b></figcaption></figure><p>after") == [("in", None, None), ("lone cap", None, None), ("after", None, None)]
    assert said(f"{image}<p>x</p><figcaption>stray</figcaption>") == [(None, "a", None), ("x", None, None), ("stray", None, None)]
    assert said(f"<figure>{image}<figcaption>cap<p>two</p> three") == [(None, "a", "cap two three")]
    assert said(f"<figure><figcaption>first</figcaption>{image}{image}<figure>{image}</figure></figure></figure>z") == [(None, "a", "first"), (None, "a", "first"), (None, "a", None), ("z", None, None)]
    assert said('<figure><img src="media:a" alt="kept"><figcaption> </figcaption></figure>') == [(None, "a", "kept")]


def test_pages_keep_every_visible_word(spark):
    """Whole pages: positions are dense, and texts and captions hold every word outside tags, scripts and styles."""
    import re
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "template")

        def handle_endtag(self, tag):
            self.hidden = max(0, self.hidden - (tag in ("script", "style", "template")))

        def handle_data(self, data):
            self.words += [] if self.hidden else re.findall(r"\w+", data)

    got = queries.pages_interleaved(spark, SF).toPandas().sort_values(["page_id", "position"])
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(pages) >= 50 and set(got["page_id"]) <= set(pages) and not got["resolved"].any()
    mine = {i: g for i, g in got.groupby("page_id")}
    for i, page in pages.items():
        parser = Words()
        parser.feed(page or "")
        parser.close()
        g = mine.get(i)
        found = [] if g is None else [w for t in g["text"].dropna() for w in re.findall(r"\w+", t)]
        captions = [] if g is None else [w for c in g.loc[g["kind"] == "media", "caption"].dropna() for w in re.findall(r"\w+", c)]
        assert not Counter("".join(parser.words)) - Counter("".join(found + captions)), i
        if g is not None:
            assert g["position"].tolist() == list(range(len(g)))
            assert g["reference"].notna().tolist() == (g["kind"] == "media").tolist()


def test_interleaving_of_whole_pages(spark):
    """Positions are dense, texts and references keep their order, and resolved and missing media stay in place."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    stored = media.texts_as_media(table(spark, [(1, "pay"), (2, "pay"), (3, "load")]))
    digests = [r[0] for r in stored.orderBy("doc_id").select("digest").collect()]
    figure = lambda d, c: f'<figure><img src="media:{d}" alt="a"><figcaption>{c}</figcaption></figure>'
    mixed = pages.withColumn("html", F.concat(F.lit("<p>head</p>" + figure(digests[0], "one")), "html", F.lit(figure(digests[2], "two") + figure("gone", "three") + "<p>tail")))
    got = media.resolve(media.sequences(mixed, "page_id"), stored).toPandas().sort_values(["doc_id", "position"])
    assert media.media_features(stored.coalesce(1)).count() == 2
    for _, page in got.groupby("doc_id"):
        assert page["position"].tolist() == list(range(len(page)))
        assert page["text"].iloc[0] == "head" and page["text"].iloc[-1] == "tail"
        refs = page[page["digest"].isin([*digests, "gone"])]
        assert refs["caption"].tolist() == ["one", "two", "three"]
        assert refs["payload_bytes"].tolist()[:2] == [64, 64] and refs["payload_sha256"].notna().tolist() == [True, True, False]


def test_pages_parse_and_miss(spark):
    pages = spark.createDataFrame([(1, '<img src="media:none">'), (2, None), (None, "text"), (1, "<p>x")], "doc_id long, html string")
    got = media.resolve(media.sequences(pages), spark.createDataFrame([], "digest string, media binary")).collect()
    assert len(got) == 3 and all(r["payload_sha256"] is None for r in got)


def check_packing(rows, got, tokenizer, capacity=1024):
    pieces = Counter()
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), math.ceil(sum(r["length"] for r in got) / capacity)


def test_packing_whole_table(spark, tokenizer):
    n, bound = check_packing(documents(spark), queries.op9_bin_completion_packing(spark, SF).collect(), tokenizer)
    assert n <= bound + 1


def test_packing_odd_rows(spark, tokenizer):
    got = packing.pack(table(spark, ODD), RANKS, PATTERN).collect()
    check_packing(ODD, got, tokenizer)
    assert packing.pack(table(spark, []), RANKS, PATTERN).count() == 0


def best_bins(items, capacity):
    """Fewest bins, by trying everything."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                bins[i] += items[k]
                go(k + 1, bins)
                bins[i] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_sets():
    rng = np.random.default_rng(2)
    fixed = [[16, 15, 14, 14, 14, 14, 13, 12, 10, 9, 8, 8]]
    assert sum(n for _, n in packing.plan(Counter(fixed[0]), 30)) == 5
    for _ in range(150):
        items = sorted(rng.integers(5, 70, rng.integers(1, 14)).tolist(), reverse=True)
        patterns = packing.plan(Counter(items), 100)
        assert Counter(s for p, n in patterns for s in p for _ in range(n)) == Counter(items)
        assert sum(n for _, n in patterns) == best_bins(items, 100)


def test_mixing_follows_its_windows(spark):
    got = queries.op10_pfair_mixing(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    blocks = got.drop_duplicates(["source", "block"])
    assert (blocks["release"] <= blocks["slot"]).all() and (blocks["slot"] < blocks["deadline"]).all() and blocks["slot"].is_unique
    for _, g in got.groupby(["source", "block"]):
        assert sorted(g["place"]) == list(range(len(g)))


def test_period_lags_stay_within_one_block(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 1), ("c", 40), ("d", 40), (None, 7)], "source string, n long").na.fill("null")
    slots = mixing.period_slots(mixing.quotas(sizes, 100), 100).orderBy("slot").collect()
    quota = {r["source"]: r["quota"] for r in slots}
    assert sum(quota.values()) == 100 == len(slots)
    had = Counter()
    for t, r in enumerate(slots, 1):
        had[r["source"]] += 1
        assert all(abs(had[s] - q * t / 100) < 1 for s, q in quota.items())


def test_mixing_odd_rows(spark):
    rows = [(i % 7, None if i % 3 else "s", "x") for i in range(50)] + [(None, "t", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.interleave(docs, block_rows=4, period=10).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert mixing.interleave(docs.limit(0)).count() == 0
    kept = mixing.in_order(docs, block_rows=4, period=10)
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(rows)


def test_mixing_keeps_sources_without_a_weight(spark):
    docs = spark.createDataFrame([(i, ["a", "b", None, "c"][i % 4]) for i in range(80)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 100), ("b", 0), ("else", 5)], "source string, n long")
    got = mixing.interleave(docs, block_rows=2, period=20, weights=weights).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[1]) for r in docs.collect())


def test_mixing_of_1200_sources(spark):
    rows = [(i, f"s{i % 1200}") for i in range(2400)]
    got = mixing.interleave(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)


def test_strip_repeats_keeps_rows_and_columns(spark):
    from tests.llm.test_dedup import small_rows

    docs = table(spark, small_rows())
    got = substring_dedup.strip_repeats(docs)
    assert got.columns == docs.columns
    whole = substring_dedup.remove_repeats(docs).select("doc_id", "n_removed", "kept").collect()
    texts = Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in got.collect())
    assert texts == Counter((r["doc_id"], r["kept"]) for r in whole)


def test_mixing_with_more_sources_than_slots(spark):
    rows = [(i, f"s{i % 30}") for i in range(60)] + [(100 + i, "hot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.interleave(docs, block_rows=4, period=20).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert len({r["slot"] for r in got}) == len({(r["source"], r["block"]) for r in got})
