"""The pipeline's stages, each against its operator's rule on its own input."""

import hashlib

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_dedup import SF, key, table
from tests.llm.test_models import ODD
from tests.llm.test_near_copies import exact_groups
from tidemark.llm import mixing
from tidemark.llm.common import materialize, with_arrival


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i in before if labels.get(i) == 0]
            assert len([i for i in clean if i in after]) > 0.9 * len(clean)
        if name == "near_duplicates":
            assert set(after) == {i for i, c in exact_groups([(i, r["text"]) for i, r in sorted(before.items())]) if i == c}
        if name == "substring_dedup":
            kept = brute.substring_dedup([(i, r["text"]) for i, r in sorted(before.items())])
            mine = [(i, hashlib.sha256(" ".join(r["text"].split(" ")).encode()).hexdigest()) for i, r in after.items() if r["text"] != before[i]["text"]]
            want = {i: h for i, _, n, h in kept if n}
            assert key(mine) == key(want.items())
        if name == "mixing":
            assert {i: r["text"] for i, r in after.items()} == {i: r["text"] for i, r in before.items()}
            unmixed = before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    # the written rows follow the slots, and sequences by number follow the rows
    order = [r["doc_id"] for r in with_arrival(docs, "__at").orderBy("__at").collect()]
    assert sorted(order) == sorted(after)
    place = {i: k for k, i in enumerate(order)}
    first = {}
    for r in packed:
        first[r["sequence_id"]] = min(first.get(r["sequence_id"], len(order)), place[r["doc_id"]])
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    slot = {r["doc_id"]: r["slot"] for r in mixing.interleave(docs).collect()}
    assert [slot[i] for i in order] == sorted(slot.values())
    # without the mixing stage other sequences come first
    plain = materialize(spark.createDataFrame(list(unmixed.values()), docs.schema).orderBy("doc_id"))
    other = corpus_pipeline.STAGES[-1][1](spark, plain, SF).collect()
    assert {(r["doc_id"], r["piece"], r["sequence_id"]) for r in other} != {(r["doc_id"], r["piece"], r["sequence_id"]) for r in packed}


def test_stages_on_odd_and_empty_tables(spark):
    """Null ids, null and empty texts, repeated rows and very long texts pass every stage; an empty table stays empty."""
    odd = table(spark, ODD).selectExpr("doc_id", "text", "'de' AS lang", "CASE WHEN doc_id > 3 THEN 's' END AS source", "CAST(char_length(text) AS BIGINT) AS n_chars")
    for docs in (odd, odd.limit(0)):
        now = materialize(docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = materialize(stage(spark, now, SF))
            assert now.columns == odd.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        left = now.collect()
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in left}
        assert bool(left) == bool(docs.count())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
