"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``stored`` nearest pivots in order. Within a shard of
vectors each pivot has an inverted file of (vector, place of the pivot in its order). A
query walks the files of its own pivots and accumulates Spearman's footrule distance of the
two orders (a pivot that is not stored has place ``stored``); the best ``share`` of the
shard (at least ``least``) is reranked by exact Euclidean distance in double precision, and
each query's ``k`` best over all shards remain.

Pivots come from a bounded sample (``sample`` vectors chosen by hash); every vector is
indexed: its order is computed once and written beside it. Shards hold up to ``shard_rows``
vectors (fewer where that would leave workers idle) and meet queries in blocks of
``block_rows``, so no task holds all vectors or all queries, and the index moves once per
block of queries. In 64 random dimensions nearest rows share few of their first pivots (of
the first 16 with the first 16 posted, a sixth of all rows must be read for 0.9), so orders
are long and every shard is walked.

Defined results: rows that share a query id give one list, merged and cut at k; vectors that are null, zero, of another length than the pivots, or hold null or
non-finite components take no part; ties go to the smaller id; a repeated id is another
candidate unless it is the query's own id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) with finite, non-zero vectors, in double precision."""
    v = vectors.withColumn("v", F.col("v").cast("array<double>"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))


def choose_pivots(vectors: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Distinct vectors of the smallest hashes; all of one length (the sample's most common).

    Only hashes are shuffled; the ``sample`` smallest come back with one vector each.
    """
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    least = hashed.groupBy("h").agg(F.min("vec_id").alias("vec_id")).orderBy("h").limit(sample)  # a bounded sample
    found = hashed.join(F.broadcast(least), ["h", "vec_id"]).groupBy("h").agg(F.min("v").alias("v")).orderBy("h")
    rows = [r[0] for r in found.select("v").collect()]
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r) for r in rows]
    size = max(sorted(set(sizes)), key=sizes.count)
    return np.array([r for r in rows if len(r) == size][:pivots])


def orders(v: np.ndarray, pivots: np.ndarray, stored: int) -> np.ndarray:
    """The ``stored`` nearest pivots of every vector, nearest first, ties to the smaller number."""
    distance = (pivots**2).sum(axis=1) - 2 * v @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")[:, :stored].astype(np.int16)


def inverted(order: np.ndarray, pivots: int, stored: int) -> np.ndarray:
    """Each pivot's file: its place in the order of every vector of the shard, ``stored`` where it is not in it."""
    files = np.full((pivots, len(order)), stored, np.int16)
    files[order, np.arange(len(order))[:, None]] = np.arange(order.shape[1], dtype=np.int16)
    return files


def footrules(files: np.ndarray, order: np.ndarray, stored: int) -> np.ndarray:
    """Footrule distance of one order to every vector, from the files of its own pivots.

    Pivots outside the order add ``stored`` less their place; over all pivots that sum is the
    same for every vector, so only the difference at the order's own pivots is walked.
    """
    own = files[order]
    return (np.abs(own - np.arange(len(order), dtype=np.int16)[:, None]) + own - np.int16(stored)).sum(axis=0, dtype=np.int32)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = 256, stored: int = 192, share: float = 0.25, least: int = 200, sample: int = 2048, shard_rows: int = 1 << 16, block_rows: int = 1 << 14) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score. ``is_query`` is a condition on vec_id."""
    base = materialize(usable(pick(vectors, vec_id=id_col, v=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))))
    chosen = choose_pivots(base, pivots, sample)
    size = chosen.shape[1]
    base = base.where(F.size("v") == size)
    stored = min(stored, len(chosen))
    n, q = base.count(), base.where(is_query).count()
    workers = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, blocks = max(1, math.ceil(n / shard_rows), min(workers, math.ceil(n / 4096))), max(1, math.ceil(q / block_rows))
    where = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            near = [row.tobytes() for row in orders(v, chosen, stored)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.binary())], names=["vec_id", "v", "near"])

    base = materialize(base.select("vec_id", "v").mapInArrow(order, "vec_id long, v array<double>, near binary"))
    index = base.select("*", where(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = base.where(is_query).select("*", where(blocks, 2).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = table.column("vec_id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
        near = np.frombuffer(b"".join(table.column("near").to_pylist()), np.int16).reshape(len(ids), stored)
        by = np.argsort(ids, kind="stable")
        return ids[by], v[by], near[by]

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, v, near_of = matrix(rows)
            qids, qv, asked_near = matrix(queries)
            files = inverted(near_of, len(chosen), stored)
            most = max(least, math.ceil(share * len(ids)))
            for qid, x, near_q in zip(qids.tolist(), qv, asked_near, strict=True):
                total = footrules(files, near_q, stored) * np.int64(len(ids)) + np.arange(len(ids))
                total = total[ids != qid]
                near = np.argpartition(total, most)[:most] if most < len(total) else np.arange(len(total))
                other = np.flatnonzero(ids != qid)[near]
                d = np.sqrt(((v[other] - x) ** 2).sum(axis=1))
                best = np.lexsort((ids[other], d))[:k]
                out[0] += [qid] * len(best)
                out[1] += ids[other][best].tolist()
                out[2] += d[best].tolist()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND, strict=True)], schema=FOUND)

    tasks = min(shards * blocks, max(4 * workers, 2000))  # work follows pairs of rows, not bytes, so small partitions are not merged
    index, asked = (t.repartition(tasks, "shard", "block") for t in (index, asked))
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
