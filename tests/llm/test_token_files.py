"""Huffman token files: optimal limited codes, exact round trips, partial reads."""

import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tests.llm.test_models import ODD
from tidemark.llm import huffman, queries, token_files
from tidemark.llm.common import new_folder

WORDS = path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def optimal(counts):
    """Bits that an unlimited Huffman code needs."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def least_limited(counts, longest):
    """Fewest bits under the limit: least cost of lengths over sorted counts with Kraft sum at most 1."""
    counts = sorted((c for c in counts if c), reverse=True)
    room = 1 << longest
    best = {room: 0}
    for c in counts:
        step = {}
        for left, cost in best.items():
            for bits in range(1, longest + 1):
                rest = left - (room >> bits)
                if rest >= 0:
                    step[rest] = min(step.get(rest, 1 << 60), cost + c * bits)
        best = step
    return min(best.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=9), st.integers(4, 6))
def test_code_lengths_are_optimal(counts, longest):
    lengths = huffman.code_lengths(np.array(counts), longest).astype(int)
    used = [c for c in counts if c]
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts)) and lengths.max(initial=0) <= longest
    if used:
        assert sum(2.0 ** -n for n in lengths if n) <= 1
        assert int((lengths * counts).sum()) == least_limited(counts, longest)
        assert int((huffman.code_lengths(np.array(counts), 40).astype(int) * counts).sum()) == optimal(counts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_stream_round_trip(ids, start, end):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=301)
    lengths = huffman.code_lengths(counts, 12)
    stream, marks = huffman.Book(lengths).encode(ids)
    decoder = huffman.Decoder(lengths)
    assert (decoder.decode(stream, marks, len(ids)) == ids).all()
    assert (decoder.decode(stream, marks, len(ids), start, end) == ids[start:end]).all()
    assert len(stream) == -(-int((lengths[ids].astype(int)).sum()) // 8)


def test_too_many_symbols_and_uncoded_symbols():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)
    with pytest.raises(ValueError):
        huffman.Book(huffman.code_lengths(np.array([3, 0, 2]), 8)).encode(np.array([1]))


def expected(tokenizer, rows):
    """(doc_id, start, n_tokens, crc32) in doc_id order; ties by any order."""
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_tokenizers_library(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op11_huffman_tokens(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(tokenizer, rows)


def test_chunks_give_whole_text_ids(spark, tokenizer):
    texts = [t for _, t in ODD[:-2]] + ["á ́b", "  x", "x  y", "ΑΣ Σ", "<|endoftext|>x <|END", "İI\x1c \x1dz", "it's \n\n\tit'S", "é é", "　 a \u0085 b", "ＡＢ 12 34", "漢 字"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_files.encode(rows, WORDS, 1).collect()}
    assert got == {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


def test_odd_rows_and_small_blocks(spark, tokenizer):
    rows = [(i, t) for i, t in ODD] + [(None, "no id"), (None, None), (5, "twin"), (5, "twin"), (9, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, ids string, part int").repartition(4)
    folder = new_folder(spark)
    token_files.write(df, folder, WORDS, 1, block_tokens=50)
    got = [tuple(r) for r in token_files.read(spark, folder).selectExpr("doc_id", "start", "n_tokens", "crc32(ids)").collect()]
    got.sort(key=lambda r: r[1])
    places = [r[0] for r in got]
    assert places == sorted(places, key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    true = expected(tokenizer, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r[0], r[2], r[3]) for r in got], key=key) == sorted([(r[0], r[2], r[3]) for r in true], key=key)
    some = {(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read(spark, folder, [5, 9, 12345]).collect()}
    assert some == {(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read(spark, folder).where("doc_id in (5, 9)").collect()} and len(some) > 2


def test_empty_table(spark):
    folder = new_folder(spark)
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, WORDS, 1)
    assert token_files.read(spark, folder).collect() == []
