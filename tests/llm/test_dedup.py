import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tidemark.llm import queries, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, bucket string, n int, fp string"


def key(rows):
    return sorted(rows, key=str)


def small_rows():
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(n))
    shared, rows = say(80), []
    for i in range(40):
        rows.append((i, say(rnd.randint(0, 60)) + " \t" + (shared if i % 3 else say(20)) + "\n" + say(rnd.randint(0, 30))))
    rows += [(100, rows[1][1]), (100, rows[1][1]), (101, None), (102, ""), (None, rows[1][1]), (103, "ab " * 400), (104, "ab " * 300), (105, "One two"), (106, "one TWO")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("bucket_rows", [1024, 3])
def test_substring_dedup_small(spark, bucket_rows):
    rows = small_rows()
    got = substring_dedup.remove_repeats(table(spark, rows), bucket_rows=bucket_rows)
    got = got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert key(map(tuple, got)) == key(brute.substring_dedup(rows))


def test_substring_dedup_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op2_substring_dedup(spark, SF).collect()]
    assert key(got) == key(brute.substring_dedup(rows))
    assert any(r[2] for r in got)


@pytest.mark.parametrize("bucket_rows", [512, 2])
def test_simhash_small(spark, bucket_rows):
    rows = small_rows()
    rnd = random.Random(1)
    long = [rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 50)) for _ in range(300)]
    for i in range(200, 260):
        copy = list(long)
        copy[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    got = simhash.near_groups(table(spark, rows), bucket_rows=bucket_rows)
    got = got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert key(map(tuple, got)) == key(brute.simhash_groups(rows))


def test_simhash_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op4_simhash_near_dedup(spark, SF).collect()]
    assert key(got) == key(brute.simhash_groups(rows))


def test_every_pigeonhole_choice_is_a_key():
    for blocks in (5, 6, 7, 8):
        masks = simhash.block_keys(blocks, 4)
        rnd = random.Random(blocks)
        for _ in range(300):
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_empty_tables(spark):
    none = table(spark, [])
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_groups(none).count() == 0


def test_components_of_random_and_long_graphs(spark):
    from tidemark.llm.components import components

    rnd = random.Random(9)
    edges = [(rnd.randrange(-300, 300), rnd.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
