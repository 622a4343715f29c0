"""Lockstep alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path
from tests.llm.test_models import ODD
from tidemark.llm import alignment

FILES = (path("byte_bpe_50k.tiktoken"), PATTERN, path("piece_bpe_32k.model"))
TEXTS = [*[t for _, t in ODD[:-2]], "a ", " a", "  ", "a  b \n\n c ", "x▁y", "<0x41> </s> <|endoftext|><unk>", "ﬁ① é　b a\x85 b", "\x00 \t x", "🙂é́" * 400, "zq" * 9000, " " * 3000, "1234567 " * 900, "日本語の文 and more"]


def plain_groups(a, b):
    """(a ids, b ids) of every group; a and b are (id, bytes) lists over the same bytes."""
    out, i, j = [], 0, 0
    while i < len(a):
        i0, j0, ea, eb = i, j, len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while ea != eb:
            if ea < eb:
                ea, i = ea + len(a[i][1]), i + 1
            else:
                eb, j = eb + len(b[j][1]), j + 1
        out.append(([x for x, _ in a[i0:i]], [x for x, _ in b[j0:j]]))
    return out


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    kept = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    back = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
    sp = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    groups = []
    for i, text in rows:
        a = b = []
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(back[c] for c in w)) for k, w in zip(e.ids, e.tokens)]
            ids = sp.encode(text)
            b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in ids]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []
        groups.append(plain_groups(a, b))
    held = Counter()
    for g in groups:
        held.update({(x, y) for a, b in g for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = Counter()
        for a, b in g:
            for x, n in Counter(a).items():
                for y, m in Counter(b).items():
                    links[x, y] += n * m
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in links.items() if held[p] == top[p[0]])
        sums = sum(n * held[p] for p, n in links.items())
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), hashlib.sha256(text.encode()).hexdigest() if g else "", best, sums))
    return out


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, batch string, n_a long").repartition(parts)
    return [tuple(r) for r in alignment.aligned_documents(df, *FILES).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()]


def test_odd_texts_and_repeated_ids_equal_the_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again one"), (3, "again one"), (7, None)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_all_documents_equal_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(got(spark, rows)) == sorted(plain(rows))


def test_batches_and_lanes_do_not_show(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for one, two in ((1, 7), (5, 3)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(one)
        a = {tuple(r) for r in alignment.aligned_documents(df, *FILES).collect()}
        b = {tuple(r) for r in alignment.aligned_documents(df.repartition(two), *FILES).collect()}
        assert a == b and len(a) == len(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30)), max_size=8))
def test_merge_of_lanes(docs):
    """Any cuts of the same bytes, with lanes of a few bytes."""
    before, alignment.LANE_BYTES = alignment.LANE_BYTES, 5
    try:
        rows = []
        for a, b in docs:
            (a if sum(a) < sum(b) else b).append(abs(sum(a) - sum(b)) or 1)
            if sum(a) != sum(b):
                (a if sum(a) < sum(b) else b).append(1)
            rows.append((a, b))
        cat = lambda k: np.array([x for r in rows for x in r[k]], np.int64)
        ends = [np.concatenate([[0], np.cumsum([len(r[k]) for r in rows])]).astype(np.int64) for k in (0, 1)]
        found = alignment.merge(cat(0), cat(1), *ends).T.tolist()
        true, a0, b0 = [], 0, 0
        for a, b in rows:
            for x, y in plain_groups([(0, b"x" * n) for n in a], [(0, b"x" * n) for n in b]):
                true.append([a0, a0 + len(x), b0, b0 + len(y)])
                a0, b0 = a0 + len(x), b0 + len(y)
        assert found == true
    finally:
        alignment.LANE_BYTES = before


@pytest.mark.parametrize("limit", [1, 1 << 14])
def test_links_of_large_groups(monkeypatch, limit):
    monkeypatch.setattr(alignment, "GROUP_LINKS", limit)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 7, 50)
    groups = np.array([[0, 10, 0, 20], [10, 11, 20, 21], [11, 60, 21, 50]]).T
    doc = np.array([0, 0, 1])
    key, times = alignment.link_counts(groups, doc, a, b, 7, 35)
    true = Counter()
    for (a0, a1, b0, b1), d in zip(groups.T, doc):
        true.update(int(d * 35 + x * 7 + y) for x in a[a0:a1] for y in b[b0:b1])
    assert dict(zip(key.tolist(), times.tolist())) == true and (np.diff(key) > 0).all()


def test_long_word_has_its_tokens():
    """A word of more than 65,535 tokens is encoded whole, not left out."""
    import pyarrow as pa

    model = alignment.encoders(*FILES)
    text = "1;7.2,9!4?" * 14000
    a, a_rows, b, b_rows = model.rows(*alignment.cut(pa.array([text, "a b"])))
    assert a_rows[1] > 65535 and not (b == alignment.BROKEN).any() and len(a_rows) == len(b_rows) == 3
    assert model.a_size[a[: a_rows[1]]].sum() == model.b_size[b[: b_rows[1]]].sum() == len(text) + 1
