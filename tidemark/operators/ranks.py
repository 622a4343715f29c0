"""Cross-sectional ranks of sessions that are larger than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored


def ranked(rows: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """``rows`` with the rank in [0, 1] of ``value`` within ``by``: ties share their mean rank, missing stays missing.

    The same numbers as ``functions.factors.rank``, which orders each session in one task. Here distinct
    values are counted first (so a value that most rows share is one row), then dealt by range: a range's ranks are
    its own cumulative counts plus the counts of the session's ranges before it, of which there are at
    most as many as partitions. Rows get theirs back by a join on (by, value).
    """
    keys = [F.col(f"`{c}`") for c in by]
    # -0.0 is 0.0, and NaN one value, as in grouping
    known = rows.where(F.col(f"`{value}`").isNotNull()).groupBy(*keys, F.col(f"`{value}`").alias("__value")).agg(F.count("*").alias("__n"))
    dealt = stored(known.repartitionByRange(*keys, F.col("__value")).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__size"))
    order = Window.partitionBy(*by).orderBy("__part")
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [F.col(f"`{c}`").alias(f"__key{i}") for i, c in enumerate(by)]
    meet = [F.col(f"`{c}`").eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(by)]
    parts = parts.select(*named, F.col("__part").alias("__of"), before.alias("__before"), F.sum("__size").over(Window.partitionBy(*by)).alias("__known"))
    inside = Window.partitionBy(*by, "__part").orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    low = dealt.withColumn("__low", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(parts, [*meet, F.col("__part") == F.col("__of")])
    rank = (F.col("__low") + F.col("__before") + (F.col("__n") - 1) / 2) / F.greatest(F.col("__known") - 1, F.lit(1))
    found = low.drop(*[f"__key{i}" for i in range(len(by))]).select(*named, F.col("__value"), rank.alias(name))
    joined = rows.join(found, [*meet, F.col(f"`{value}`") == F.col("__value")], "left")
    return joined.select(*rows.columns, name)
