"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _unsettled(pairs: DataFrame) -> bool:
    """Whether some node has two parents, or is a parent and has one."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return bool(nodes.agg(F.max((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("parent") > 0)))).first()[0])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its smallest node.

    Every round writes its edges to the shared folder, so a lost executor costs one round;
    rounds end when the edges are stars around smallest nodes. No edge list reaches the
    driver; it sees one truth value a round. The large-star join has two written sides, so a
    node with most of the edges can be split; in the small-star step a node holds only its
    smaller neighbours. Self-loops and repeated edges are allowed; an empty table gives an
    empty one.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs)
    for _ in range(most_rounds):
        if not _unsettled(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        up = F.explode(F.array_distinct(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")
        pairs = materialize(small.select(up).select("e.*").where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
