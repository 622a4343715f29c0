"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, per_class: int, most_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training documents (doc_id, text, label) of each label 0 and 1.

    ``docs`` has doc_id and text; ``trains`` selects ids to learn from. Rows are chosen by a hash of the id, and only
    documents of at most ``most_bytes`` teach. Also returns how many rows each label has, for weights.
    """
    pool = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(trains & F.col("label").isin(0, 1))
    counts = {r[0]: r[1] for r in pool.groupBy("label").count().collect()}
    order = [F.xxhash64(F.lit("sample"), F.col("doc_id")), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        part = pool.where(F.col("label") == value).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most 2 * per_class rows of two numbers
    return docs.where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), counts
