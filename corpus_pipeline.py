"""Training-corpus pipeline: five stages over ``documents``, each written and read again.

1. toxicity: documents that the string-kernel machine rejects go.
2. near_duplicates: documents of Jaccard similarity 0.8 or more on five-word shingles link up;
   of each component the one with the smallest id stays.
3. substring_dedup: words of repeated 50-word passages go; every document stays.
4. mixing: documents are dealt in Pfair order of their sources, the order of the written
   rows; every document stays.
5. packing: documents are tokenised and packed into sequences of 1024 tokens, which are
   numbered by the mixing order of their earliest piece.

The first four return the columns of ``documents``. No stage has an SQL form: the learned
machine, the connected components and the packing search have none.
"""

from __future__ import annotations

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_copies, packing, substring_dedup, toxicity
from tidemark.llm.common import materialize, read, with_arrival
from tidemark.llm.sampling import fold


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.strip_repeats(docs)
    return out.selectExpr(*["CAST(char_length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in out.columns]) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(with_arrival(docs, "__arrival"), path("byte_bpe_50k.tiktoken"), PATTERN, arrival="__arrival")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", repeats), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last keeps is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
