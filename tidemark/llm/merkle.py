"""Merkle manifest of a table, and proofs of many of its rows at once (octopus multiproofs).

A row is a leaf: sha256 over its columns, each ``-`` if null, else its UTF-8 byte count, a
colon and its value. Leaves of one scope (a value of ``scope_col``) ascend by id; while
several nodes remain, every ``FAN`` consecutive ones become the digest of their hex digests
(the last run may hold fewer, even one). The scopes' roots, null first and then bytewise by
scope, make a tree of the same kind, whose root stands for the table.

``build`` numbers leaves in two levels (range partitions, then places in them), hashes whole
subtrees of ``FAN ** RISE`` leaves each in a task of its own, and the few nodes above them level
by level. ``prove`` deals the wanted leaves in runs of neighbours. A run works out the union of
node coordinates that its proofs need and that its own leaves do not give, fetches these in
one join, hashes the interiors that its proofs share, and writes out each leaf's proof from
them. ``fold`` recomputes the root from a leaf and its proof alone.

A group holds at most ``FAN ** RISE`` leaves, whatever the scope's size. Only the root (one
digest) and the number of scopes reach the driver.

Defined results: null ids come first in their scope; rows of one id stand by their leaf
digest; equal rows are leaves of their own; an empty table has no root and no proofs; columns
other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN = 8
#: Levels of the subtrees that one task hashes.
RISE = 5
#: Scope of the tree over the scopes' roots; no column value is named so.
TOP = "top"

NODES = "scope string, level int, idx long, digest string"


def framed(column: Column) -> Column:
    """A value with its byte count, or ``-``."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """Leaf digest of a row."""
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _hash(block: bytes) -> bytes:
    return sha256(block).hexdigest().encode()


@dataclass
class Manifest:
    """``leaves``: scope, idx, leaf and carried columns. ``nodes``: scope, level, idx, digest of every
    node, leaves and the tree over scopes (scope ``TOP``) included. ``scopes``: scope, n, place, subroot.
    """

    leaves: DataFrame
    nodes: DataFrame
    scopes: DataFrame
    n_scopes: int
    root: str | None


def numbered(rows: DataFrame, scope: str, order: list[Column]) -> DataFrame:
    """``rows`` (written) with idx, the place from 0 in their scope by ``order``."""
    keys = [F.col(scope), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    before = F.sum("n").over(Window.partitionBy(scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = stored.groupBy(scope, "__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    runs = runs.select(scope, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return stored.join(runs, [scope, "__part"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def grow(leaves: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Every node above ``leaves`` (scope, idx, leaf): NODES. ``sizes`` has scope and n, of which ``most`` is the greatest."""

    def subtree(key: tuple, rows: pa.Table) -> pa.Table:
        scope, run, n = (k.as_py() for k in key)
        order = np.argsort(rows.column("idx").to_numpy())
        level = rows.column("leaf").take(pa.array(order)).to_pylist()
        levels, places, digests = [], [], []
        for up in range(1, min(RISE, height(n)) + 1):
            level = [sha256("".join(level[i : i + FAN]).encode()).hexdigest() for i in range(0, len(level), FAN)]
            levels += [up] * len(level)
            places += range(run * FAN ** (RISE - up), run * FAN ** (RISE - up) + len(level))
            digests += level
        return pa.table({"scope": pa.array([scope] * len(levels), pa.string()), "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string())})

    dealt = leaves.select("scope", "idx", "leaf").join(sizes.select("scope", "n"), "scope").withColumn("run", F.expr(f"idx div {FAN**RISE}"))
    nodes = materialize(dealt.groupBy("scope", "run", "n").applyInArrow(subtree, NODES))
    level = nodes
    for up in range(RISE + 1, height(most) + 1):
        several = level.where(F.col("level") == up - 1).join(sizes.where(F.col("n") > FAN ** (up - 1)).select("scope"), "scope", "left_semi")
        runs = several.groupBy("scope", F.expr(f"idx div {FAN}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        level = materialize(runs.select("scope", F.lit(up).alias("level"), "idx", F.sha2(F.array_join("run.digest", ""), 256).alias("digest")))
        nodes = nodes.unionByName(level)
    return nodes


def tip(nodes: DataFrame, leaves: DataFrame, sizes: DataFrame) -> DataFrame:
    """The root of every scope: scope, n, subroot. It is the node of the scope's highest level; a lone leaf itself."""
    first = nodes.where("idx = 0").groupBy("scope").agg(F.max_by("digest", "level").alias("subroot"))
    lone = leaves.join(sizes.where("n = 1").select("scope"), "scope", "left_semi").select("scope", F.col("leaf").alias("subroot"))
    return sizes.join(first.unionByName(lone), "scope")


def build(docs: DataFrame, digest: Column, id_col: str = "doc_id", scope_col: str = "lang", carry: dict[str, Column] | None = None) -> Manifest:
    """Hash ``docs`` into a manifest; leaves keep doc_id and the ``carry`` columns."""
    scope = F.coalesce(F.concat(F.lit("s:"), F.col(f"`{scope_col}`").cast("string")), F.lit("n"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), scope.alias("scope"), digest.alias("leaf"), *[c.alias(a) for a, c in (carry or {}).items()])
    leaves = materialize(numbered(materialize(rows), "scope", [F.asc_nulls_first("doc_id"), F.asc("leaf")]))
    sizes = materialize(leaves.groupBy("scope").agg(F.count("*").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = grow(leaves, sizes, most)
    scopes = tip(nodes, leaves, sizes).withColumn("one", F.lit(TOP))
    scopes = materialize(numbered(scopes, "one", [F.asc("scope")]).withColumnRenamed("idx", "place"))
    n_scopes = scopes.count()
    upper = scopes.select(F.col("one").alias("scope"), F.col("place").alias("idx"), F.col("subroot").alias("leaf"))
    top_size = docs.sparkSession.createDataFrame([(TOP, n_scopes)], "scope string, n long")
    top = grow(upper, top_size, n_scopes)
    root = tip(top, upper, top_size).first()
    ground = leaves.select("scope", "idx", "leaf").unionByName(upper).select("scope", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    return Manifest(leaves, nodes.unionByName(top).unionByName(ground), scopes.drop("one"), n_scopes, root["subroot"] if root else None)


def missing(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, idx) of the fewest nodes that, with the leaves at ``places`` of ``n``, give all their proofs."""
    levels, wanted, have, up = [], [], np.unique(places), 0
    while n > 1:
        runs = np.unique(have // FAN)
        children = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        lacking = np.setdiff1d(children[children < n], have, assume_unique=True)
        wanted.append(lacking)
        levels.append(np.full(len(lacking), up))
        have, n, up = runs, -(-n // FAN), up + 1
    return (np.concatenate(levels), np.concatenate(wanted)) if levels else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _rise(have: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes]) -> tuple[list[dict[int, bytes]], dict[int, bytes]]:
    """Per level the joined children of every run above ``have``, and the tree's root by its idx 0."""
    runs, up = [], 0
    while n > 1:
        level = {}
        for r in dict.fromkeys(i // FAN for i in have):
            level[r] = b"".join(have[i] if i in have else fetched[up, i] for i in range(r * FAN, min(n, r * FAN + FAN)))
        runs.append(level)
        have, n, up = {r: _hash(block) for r, block in level.items()}, -(-n // FAN), up + 1
    return runs, have


def _tails(runs: list[dict[int, bytes]], above: bytes) -> dict[int, bytes]:
    """Per run of the lowest level the siblings from the level over it up, then ``above``."""
    tails = {0: above}
    for level in reversed(runs[1:]):
        tails = {r * FAN + k: block[: 64 * k] + block[64 * k + 64 :] + tails[r] for r, block in level.items() for k in range(len(block) // 64)}
    return tails


def prove(manifest: Manifest, targets: DataFrame | None = None) -> DataFrame:
    """Rows of ``targets`` (of ``manifest.leaves``; all by default) with n, place, subroot and ``proof``.

    The proof is the text of the siblings' digests, level by level from the leaf to the root, left to
    right; ``idx``, ``n``, ``place`` and the number of scopes tell where each stands.
    """
    targets = manifest.leaves if targets is None else targets
    n_scopes = manifest.n_scopes
    rows = targets.join(manifest.scopes, "scope").withColumn("run", F.expr(f"idx div {FAN**RISE}"))

    def wanted(key: tuple, run: pa.Table) -> pa.Table:
        scope, number, n, place = (k.as_py() for k in key)
        level, idx = missing(run.column("idx").to_numpy(), n)
        top_level, top_idx = missing(np.array([place]), n_scopes)
        trees = [scope] * len(level) + [TOP] * len(top_level)
        return pa.table(
            {
                "owner": pa.array([scope] * len(trees), pa.string()),
                "run": pa.array([number] * len(trees), pa.int64()),
                "scope": pa.array(trees, pa.string()),
                "level": pa.array(np.concatenate([level, top_level]), pa.int32()),
                "idx": pa.array(np.concatenate([idx, top_idx]), pa.int64()),
            }
        )

    coordinates = rows.select("scope", "run", "n", "place", "idx").groupBy("scope", "run", "n", "place").applyInArrow(wanted, "owner string, run long, scope string, level int, idx long")
    fetched = coordinates.join(manifest.nodes, ["scope", "level", "idx"]).select("owner", "run", "scope", "level", "idx", "digest")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("run").dtypes) + ", proof string"
    kept = [c for c in rows.columns if c != "run"]

    def expand(mine: pa.Table, nodes: pa.Table) -> pa.Table:
        lower, upper = {}, {}
        for scope, level, idx, digest in zip(*[nodes.column(c).to_pylist() for c in ("scope", "level", "idx", "digest")], strict=True):
            (upper if scope == TOP else lower)[level, idx] = digest.encode()
        places = mine.column("idx").to_pylist()
        have = {i: d.encode() for i, d in zip(places, mine.column("leaf").to_pylist(), strict=True)}
        runs, root = _rise(have, mine.column("n")[0].as_py(), lower)
        place = mine.column("place")[0].as_py()
        over, _ = _rise({place: root[0]} if runs else {place: have[0]}, n_scopes, upper)
        above = b""
        for k, level in enumerate(over):
            at = 64 * (place // FAN**k % FAN)
            block = level[place // FAN ** (k + 1)]
            above += block[:at] + block[at + 64 :]
        tails = _tails(runs, above)
        proofs = []
        for i in places:
            if not runs:
                proofs.append(above)
                continue
            block, at = runs[0][i // FAN], 64 * (i % FAN)
            proofs.append(block[:at] + block[at + 64 :] + tails[i // FAN])
        return mine.select(kept).append_column("proof", pa.array([p.decode() for p in proofs], pa.string()))

    return rows.groupBy("scope", "run").cogroup(fetched.groupBy("owner", "run")).applyInArrow(expand, schema)


def fold_one(digest: str, proof: str, idx: int, n: int, place: int, n_scopes: int) -> str:
    """The root that a leaf digest and a proof give."""
    h, rest = digest.encode(), proof.encode()
    for at, size in ((idx, n), (place, n_scopes)):
        while size > 1:
            run = at // FAN * FAN
            left, right = 64 * (at - run), 64 * (min(size, run + FAN) - at - 1)
            h = _hash(rest[:left] + h + rest[left : left + right])
            rest, at, size = rest[left + right :], at // FAN, -(-size // FAN)
    return h.decode()


def fold(proofs: DataFrame, n_scopes: int, digest: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``proofs`` and folded_root, recomputed from the digests in ``digest`` and the proofs."""
    kinds = dict(proofs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            roots = [fold_one(*r, n_scopes) for r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], pa.array(roots, pa.string())], [*keep, "folded_root"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", folded_root string"
    return proofs.select(F.col(digest).alias("__digest"), F.col("proof").alias("__proof"), F.col("idx").alias("__idx"), F.col("n").alias("__n"), F.col("place").alias("__place"), *keep).mapInArrow(run, schema)
