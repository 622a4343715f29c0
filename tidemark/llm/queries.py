"""Registered queries of this subpackage; each runs over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, masked_lm, media, merkle, mixing, oracle, packing, permutation_ann, quality, simhash, substring_dedup, token_files, token_spans, toxicity
from .common import new_folder, read
from .sampling import fold

RANKS = "byte_bpe_50k.tiktoken"


def _scored(scores: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return _scored(scores, 3, 1, 0.5)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.count_sections(read(spark, sf_dir, "documents"), path(RANKS), PATTERN)


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(read(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.texts_as_media(read(spark, sf_dir, "documents"))
    parts = media.resolve(media.sequences(stored.select("doc_id", "html")).where("kind = 'media'").drop("text"), stored.select("digest", "media"))
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return parts.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every page, in order; references name no stored media here and keep their place."""
    parts = media.sequences(read(spark, sf_dir, "pages"), "page_id")
    stored = spark.createDataFrame([], "digest string, media binary")
    found = media.resolve(parts, stored)
    return found.select(F.col("doc_id").alias("page_id"), "position", "kind", "text", F.col("digest").alias("reference"), "caption", F.col("media_bytes").isNotNull().alias("resolved"))


def op8_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return _scored(scores, 4, 2, 0.3)


def op9_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), path(RANKS), PATTERN)


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(read(spark, sf_dir, "documents"))


def op11_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    token_files.write(read(spark, sf_dir, "documents"), folder, path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(fold("doc_id", 3) == 0, merkle.leaf(*columns, lowered))
    manifest = merkle.build(docs, merkle.leaf(*columns, F.col("text")), carry={"tampered": tampered})
    proofs = merkle.prove(manifest).withColumn("claimed", F.coalesce("tampered", "leaf")).withColumn("proof_sha256", F.sha2("proof", 256))
    root = F.lit(manifest.root).cast("string")
    folded = merkle.fold(proofs, manifest.n_scopes, "claimed", ["doc_id", "leaf", "subroot", "proof_sha256"])
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(read(spark, sf_dir, "documents"), path(RANKS), PATTERN, path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality_crf, op2_substring_dedup, op3_permutation_ann, op4_simhash_near_dedup, op5_token_counts, op6_masked_lm, op7_media_columns, op8_toxicity_string_kernel, op9_bin_completion_packing, op10_pfair_mixing, op11_huffman_tokens, op12_merkle_manifest, op13_lockstep_alignment, pages_interleaved)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracle.SUBSTRING, "op10_pfair_mixing": oracle.MIXING, "op12_merkle_manifest": oracle.merkle()}
