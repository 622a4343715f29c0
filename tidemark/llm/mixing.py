"""Interleaving sources at target weights by Pfair scheduling, in DataFrame functions only.

A source with quota q of the period's M slots has the weight w = q/M. Its block b (from 0)
may not come before its release floor(b/w) and must come before its deadline
ceil((b+1)/w). One period is filled slot by slot with the released block of earliest
deadline; as quotas sum to M, every deadline holds, so that after t slots each source has
had within one block of w*t. The period repeats, so block b of a source has slot
(b div q)*M + (slot of its b mod q in the period): one lookup per block, whatever the input.

Documents are numbered within their source by the order of md5(id): ranks inside a short
md5 prefix plus the counts before it, so a source with most rows is spread over tasks.

A source that runs out leaves its later slots empty; nothing is dropped or repeated.
Defined results: a null source is a source of its own; null ids sort by the digest of the
empty string; repeated ids keep a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick


def quotas(sizes: DataFrame, period: int) -> DataFrame:
    """Slots per source (source, quota): one each, the rest by the square root of its rows.

    ``sizes`` has source and n. Largest remainders get what rounding leaves; all integers.
    """
    every = Window.partitionBy(F.lit(1))
    share = F.floor(F.sqrt("n") * 1000).cast("long")
    spare = F.lit(period).cast("long") - F.count("*").over(every)
    out = sizes.withColumn("share", share).withColumn("spare", spare).withColumn("total", F.sum("share").over(every))
    out = out.withColumn("base", F.expr("spare * share div total")).withColumn("part", F.expr("spare * share % total"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("part"), "source"))
    left = F.col("spare") - F.sum("base").over(every)
    return out.select("source", (F.col("base") + 1 + F.when(rank <= left, 1).otherwise(0)).cast("int").alias("quota"))


def period_slots(shares: DataFrame, period: int) -> DataFrame:
    """Earliest-deadline-first slots of one period (source, quota, turn, slot)."""
    one = shares.agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("all"))
    chosen = f"""
        aggregate(sequence(0, {period - 1}),
          struct(transform(all, x -> 0) AS done, cast(array() AS array<int>) AS picks),
          (s, t) -> transform(array(array_min(transform(all, (x, i) ->
              CASE WHEN s.done[i] < x.quota AND s.done[i] * {period}L div x.quota <= t
                   THEN struct(((s.done[i] + 1) * {period}L + x.quota - 1) div x.quota AS due, i AS i) END))),
            p -> struct(transform(s.done, (d, i) -> CASE WHEN i = p.i THEN d + 1 ELSE d END) AS done,
                        concat(s.picks, array(p.i)) AS picks))[0],
          s -> s.picks)"""
    slots = one.where("size(all) > 0").withColumn("picks", F.expr(chosen)).select("all", F.posexplode("picks").alias("slot", "i"))
    row = slots.select(F.expr("all[i].source").alias("source"), F.expr("all[i].quota").alias("quota"), "slot")
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return row.withColumn("turn", turn)


def interleave(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16, period: int = 1000, weights: DataFrame | None = None) -> DataFrame:
    """Every document's place: doc_id, source, block, release, deadline, slot, place.

    ``weights`` (source, n) replaces the sources' row counts as the base of the quotas;
    a source that it does not name, or names with nothing, counts as one of weight 1. A period has ``period`` slots; with more than half as many
    sources, the next power of two from twice their number.
    """
    base = pick(docs, doc_id=id_col, source=source_col).withColumn("source", F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")))
    base = base.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = base.groupBy("source").agg(F.count("*").alias("n"))
    rows = base.count()
    digits = max(1, math.ceil(math.log(max(rows, 2), 16) / 2))
    base = base.withColumn("prefix", F.substring("digest", 1, digits))
    counts = base.groupBy("source", "prefix").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("source", "prefix", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "prefix").orderBy("digest", "doc_id")) - 1
    given = sizes
    if weights is not None:
        named = weights.groupBy(F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null")).alias("source")).agg(F.max("n").alias("n"))
        given = sizes.select("source").join(named, "source", "left").select("source", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"))
    sources = given.count()
    if 2 * sources > period:
        period = 1 << (2 * sources - 1).bit_length()
    slots = period_slots(quotas(given, period), period)
    share = slots.select("source", "quota").distinct()
    numbered = base.withColumn("rank", rank).join(before, ["source", "prefix"])
    block = ((F.col("rank") + F.col("before")) / block_rows).cast("long")
    # quotas and slots have at most ``period`` rows, a few a source
    placed = numbered.withColumn("block", block).join(F.broadcast(share), "source")
    placed = placed.withColumn("place", F.col("rank") + F.col("before") - F.col("block") * block_rows)
    placed = placed.withColumn("turn", (F.col("block") % F.col("quota")).cast("int"))
    placed = placed.join(F.broadcast(slots.drop("quota")), ["source", "turn"])
    return placed.select(
        "doc_id",
        F.when(F.col("source") != "null", F.substring("source", 3, 1 << 30)).alias("source"),
        "block",
        F.expr(f"block * {period} div quota").alias("release"),
        F.expr(f"((block + 1) * {period} + quota - 1) div quota").alias("deadline"),
        (F.expr("block div quota") * period + F.col("slot")).alias("slot"),
        F.col("place").cast("long").alias("place"),
    )


def in_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows of ``docs`` dealt in slot order: within a written file, and from file to file.

    Rows of a repeated id share their first slot; rows without an id come last.
    """
    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = interleave(docs, id_col, source_col, **options).where("doc_id is not null").groupBy("doc_id").agg(F.min("slot").alias("__slot")).withColumnRenamed("doc_id", "__id")
    slots = materialize(slots)
    joined = docs.join(slots.hint("merge"), docs[id_col].cast("long") == slots["__id"], "left")
    # ids spread the rows that share a slot or have none
    order = [F.asc_nulls_last("__slot"), F.xxhash64(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")]
    return joined.repartitionByRange(files, *order).sortWithinPartitions(*order).select(*docs.columns)
