"""Near-duplicate components at Jaccard similarity 0.8 on five-word shingles, by SimHash blocks.

At that similarity about 15 % of the bits of two SimHashes differ, too many for blocks that a
pair must share. So a text has a wide SimHash, of ``words`` words of 64 bits (each over
its distinct shingles, whose XXH64 is mixed anew), and a block is a random choice of its
bits, long enough that a bucket holds about 512 texts by chance. A pair whose bits
differ with probability q shares none of n blocks of b bits with probability (1 - (1 - q)**b)**n.
There are as many blocks as make that 0.0002 at q = 0.1875, the most at Jaccard 0.8 (sets of four and
five shingles; from some ten shingles on q is 0.151). Within a bucket, pairs whose first two
words differ by ``radius`` bits at most, and whose numbers of distinct shingles differ by no more than that similarity
allows, are candidates, and every candidate is checked by the
exact Jaccard similarity of its texts.

Work is on distinct shingle multisets, so exact copies cost one row. In a bucket, rows with
up to four candidates give all of them. The others form crowds: a breadth-first walk gives a tree of
candidates, of which a row's four nearest over all buckets are checked first, and every crowd that the checked
links leave in several components is walked whole by its texts, which gives n - 1 links at most. The crowds that a group
of texts forms in many blocks share rows and are walked as one (`_merged`), not once a block. The first ``EARLY`` blocks
are searched before the others: pairs within one of their groups are walked anyway, so they are no candidates later,
and a large group does not come out of every block. Buckets of more than
``bucket_rows`` are cut into chunks, and every pair of chunks is searched by itself; no bucket is dropped or capped.

Defined results: texts without words are copies of each other; texts of fewer than five
words have their whole word sequence as only shingle; repeated ids keep a row each and go or
stay together; rows without an id stay and link nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick
from .components import components
from .simhash import _bits, shingle_hashes

#: Candidates of a row in its bucket up to which it gives all of them.
SMALL = 4

#: Blocks searched before the others, whose crowds are not found again.
EARLY = 8

#: Most probable share of differing bits at Jaccard 0.8, and the share of such pairs that may meet in no block.
DIFFERS, MISSED = 0.1875, 0.0002


def block_sizes(n: int, bucket: int = 512) -> tuple[int, int]:
    """Bits of a block and number of blocks for ``n`` texts."""
    bits = min(max(10, math.ceil(math.log2(max(n, 1) / bucket))), 20)
    return bits, math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFERS) ** bits)))


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct ``hashes``, and where the rows begin in them."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return hashes[new], np.searchsorted(row[new], np.arange(len(begin)))


def wide_hashes(hashes: np.ndarray, begin: np.ndarray, words: int, seed: int = 42) -> np.ndarray:
    """SimHashes (row, word) over each row's distinct shingles."""
    return _wide(*distinct(hashes, begin), words, seed)


def _wide(hashes: np.ndarray, first: np.ndarray, words: int, seed: int = 42) -> np.ndarray:
    out = np.zeros((len(first) - 1, words), np.uint64)
    flip, one, two = np.random.default_rng(seed).integers(0, 1 << 64, (3, words), np.uint64)
    for k in range(words):
        mixed = (hashes ^ flip[k]) * (one[k] | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * (two[k] | np.uint64(1))
        out[:, k] = _bits(mixed ^ (mixed >> np.uint64(29)), first)
    return out


def block_keys(wide: np.ndarray, bits: int, blocks: int, seed: int = 42) -> np.ndarray:
    """Keys (row, block): the chosen bits of each block."""
    rng = np.random.default_rng(seed)
    every = np.unpackbits(wide.view(np.uint8), axis=1)
    out = np.zeros((len(wide), blocks), np.int32)
    for k in range(blocks):
        out[:, k] = every[:, rng.choice(64 * wide.shape[1], bits, replace=False)] @ (1 << np.arange(bits, dtype=np.int32))
    return out


def digests(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number per row for its multiset of shingles; 0 without shingles."""
    full = np.diff(begin) > 0
    out = np.zeros(len(full), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(hashes, begin[:-1][full])
    return out


def _marks(docs: DataFrame, shingle: int, words: int, bits: int, blocks: int) -> DataFrame:
    """(doc_id, node, one, two, size, keys) of ``docs`` (doc_id, text); rows without words have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, begin in shingle_hashes(batch.column(1), shingle):
                n, full = len(begin) - 1, np.diff(begin) > 0
                each, first = distinct(hashes, begin)
                wide = _wide(each, first, words)
                keys = block_keys(wide[full], bits, blocks)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * blocks)]).astype(np.int32)), pa.array(keys.ravel()))
                pair = [pa.array(np.ascontiguousarray(wide[:, k]).view(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(digests(hashes, begin).view(np.int64)), *pair, pa.array(np.diff(first).astype(np.int32)), lists], names=["doc_id", "node", "one", "two", "size", "keys"])
                at += n

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, one long, two long, size int, keys array<int>")


def _differ(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differing bits of two-word fingerprints and those of ``at`` (the last axis holds the words)."""
    return np.bitwise_count(fp ^ at).sum(axis=-1, dtype=np.int64)


def _fit(size: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be so similar: the smaller holds that share of the larger at least."""
    return np.minimum(size, at) >= similarity * np.maximum(size, at) - 1e-9


def _walk(fp: np.ndarray, size: np.ndarray, radius: int, similarity: float, sets: list[np.ndarray] | None = None, known: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """Links (member, the row it was reached from) that join all rows within ``radius`` whose ``size`` fits and, given ``sets``, similar enough; and each row's first.

    Rows of one ``known`` component are reached from each other without a link.
    """
    if sets is not None:
        begin = np.concatenate([[0], np.cumsum(size)])
        names, code = np.unique(np.concatenate(sets), return_inverse=True)
    free, root = np.arange(1, len(fp)), 0
    queue, u, v, label = [0], [], [], np.zeros(len(fp), np.int64)
    while len(free):
        x = queue.pop() if queue else -1
        if x < 0:
            root = x = int(free[0])
            free, label[x] = free[1:], root
        if known is not None and (same := known[free] == known[x]).any():
            label[free[same]] = root
            queue += free[same].tolist()
            free = free[~same]
        got = free[(_differ(fp[free], fp[x]) <= radius) & _fit(size[free], size[x], similarity)]
        if sets is not None and len(got):
            has = np.zeros(len(names), bool)
            has[code[begin[x] : begin[x + 1]]] = True
            part = size[got]
            first = np.cumsum(part) - part
            both = np.add.reduceat(has[code[np.repeat(begin[got] - first, part) + np.arange(part.sum())]], first, dtype=np.int64)
            got = got[both >= similarity * (part + size[x] - both)]
        if len(got):
            free = free[~np.isin(free, got)]
            label[got] = root
            u += got.tolist()
            v += [x] * len(got)
            queue += got.tolist()
    return u, v, label


def _search(radius: int, similarity: float):
    """Candidates (u, v, bits -1, crowd 0) and rows of crowds (u, the row v that its tree reached it from or itself, bits, crowd) of each (block, key, cell) run of rows sorted by it; runs may cross batches.

    Rows of one ``walked`` group are no candidates.
    """

    def bucket(node: np.ndarray, fp: np.ndarray, size: np.ndarray, walked: np.ndarray) -> tuple[list[np.ndarray], ...]:
        step = max(1, (1 << 20) // len(node))
        slabs = range(0, len(node), step)
        close = [(_differ(fp[a : a + step, None], fp[None]) <= radius) & _fit(size[a : a + step, None], size[None], similarity) & (walked[a : a + step, None] != walked) for a in slabs]
        busy = np.concatenate([c.sum(axis=1) for c in close]) > SMALL
        u, v = [], []
        for a, c in zip(slabs, close, strict=True):
            i, j = np.nonzero(c)
            i += a
            keep = (i > j) & ~(busy[i] & busy[j])
            u.append(node[i[keep]])
            v.append(node[j[keep]])
        bits, crowd = [np.full(len(x), -1) for x in u], [np.zeros(len(x), np.int64) for x in u]
        at = np.flatnonzero(busy)
        if len(at):
            a, b, label = _walk(fp[at], size[at], radius, similarity)
            parent, names = np.arange(len(at)), np.zeros(len(at), np.int64)
            parent[a] = b
            for x in np.unique(label):
                held = label == x
                # equal crowds of several buckets have one number
                names[held] = int.from_bytes(hashlib.blake2b(np.sort(node[at][held]).tobytes(), digest_size=8).digest(), "little", signed=True) | 1
            u.append(node[at])
            v.append(node[at[parent]])
            bits.append(_differ(fp[at], fp[at[parent]]))
            crowd.append(names)
        return u, v, bits, crowd

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        node, fp = frame["node"].to_numpy(np.int64), frame[["one", "two"]].to_numpy(np.int64).view(np.uint64)
        size, walked, ids = frame["size"].to_numpy(np.int64), frame["walked"].to_numpy(np.int64), frame[["block", "key", "cell"]].to_numpy()
        new = np.append(True, (ids[1:] != ids[:-1]).any(axis=1)) if len(ids) else np.zeros(0, bool)
        begin = np.append(np.flatnonzero(new), len(ids))
        out = [], [], [], []
        for k in np.flatnonzero(np.diff(begin) > 1).tolist():
            found = bucket(*(x[begin[k] : begin[k + 1]] for x in (node, fp, size, walked)))
            for held, more in zip(out, found, strict=True):
                held += more
        none = [np.zeros(0, np.int64)]
        u, v, bits, crowd = (np.concatenate(none + x) for x in out)
        turned = (crowd == 0) & (u < v)
        return pd.DataFrame({"u": np.where(turned, v, u), "v": np.where(turned, u, v), "bits": bits, "crowd": crowd}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            open_ = (frame[["block", "key", "cell"]] == frame[["block", "key", "cell"]].iloc[-1]).all(axis=1).to_numpy()
            rest = frame[open_].reset_index(drop=True)
            yield links(frame[~open_].reset_index(drop=True))
        if rest is not None:
            yield links(rest)

    return run


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for hashes, begin in shingle_hashes(column, shingle):
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def _similar(similarity: float, shingle: int):
    """Links (u, v, one, two) whose two texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(_sets(batch.column(2), shingle), _sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def node_texts(needed: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, text): one text of ``docs`` (doc_id, text) for each of ``needed`` (node, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [digests(h, b) for h, b in shingle_hashes(batch.column(0), shingle)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *node]).view(np.int64)), batch.column(0)], names=["node", "text"])

    # ids may be repeated, so each text's node is found anew
    held = docs.join(needed.select(F.col("least").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    texts = held.select("text").mapInArrow(run, "node long, text string").join(needed.select("node"), "node", "left_semi")
    return materialize(texts.dropDuplicates(["node"]))


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """(least, crowd, node, whole): crowds ``rows`` (crowd, node) that share rows as one.

    One of more than ``most`` rows is cut into chunks, and every pair of chunks is a crowd (``whole``: each pair of its rows meets), unless its first crowds hold fewer rows in all.
    """
    rows = rows.select("crowd", "node").distinct().withColumn("least", F.min("node").over(Window.partitionBy("crowd")))
    shared = rows.withColumn("least", F.min("least").over(Window.partitionBy("node")))
    shared = materialize(shared.withColumn("least", F.min("least").over(Window.partitionBy("crowd"))))
    chunks = F.ceil(2 * F.col("n") / most).cast("int")
    sizes = materialize(shared.groupBy("least").agg(F.countDistinct("node").alias("n"), F.count("*").alias("rows")).withColumn("chunks", F.when(F.col("n") <= most, 1).otherwise(chunks)))
    sized = shared.join(sizes, "least")
    whole = (
        sized.where("n * greatest(chunks - 1, 1) <= rows")
        .select("least", "node", "chunks")
        .distinct()
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where("chunks = 1 or part <> other")
        .select("least", (F.least("part", "other") * F.col("chunks") + F.greatest("part", "other")).cast("long").alias("crowd"), "node", F.lit(True).alias("whole"))
    )
    return materialize(whole.unionByName(sized.where("n * greatest(chunks - 1, 1) > rows").select("least", "crowd", "node", F.lit(False).alias("whole"))))


def _found(nodes: DataFrame, blocks: str, similarity: float, radius: int, bucket_rows: int) -> DataFrame:
    """Candidates and rows of crowds of ``nodes`` (node, one, two, size, walked, keys) in some of the blocks."""
    rows = nodes.select("node", "one", "two", "size", "walked", F.posexplode("keys").alias("block", "key")).where(blocks)
    large = materialize(rows.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    cells = (
        rows.join(large, ["block", "key"], "left")
        .withColumn("chunks", F.coalesce(F.ceil(F.col("n") / bucket_rows).cast("int"), F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # the task of the pair of chunks (a, b), a <= b, has number a * chunks + b
        .withColumn("cell", (F.least("part", "other") * F.col("chunks") + F.greatest("part", "other")).cast("int"))
        .select("block", "key", "cell", "node", "one", "two", "size", "walked")
    )
    dealt = cells.repartition("block", "key", "cell").sortWithinPartitions("block", "key", "cell")
    return materialize(dealt.mapInPandas(_search(radius, similarity), "u long, v long, bits long, crowd long"))


def similar_links(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, radius: int, bucket_rows: int) -> DataFrame:
    """Links (u, v) between similar ``nodes`` (node, least, one, two, size, keys) that join all those that share a block."""
    merged = lambda found: _merged(found.where("crowd <> 0").select("crowd", F.col("u").alias("node")), bucket_rows)
    early = _found(nodes.withColumn("walked", F.col("node")), f"block < {EARLY}", similarity, radius, bucket_rows)
    crowds = merged(early)
    walked = materialize(crowds.where("whole").groupBy("node").agg(F.min("least").alias("least")).select("node", F.xxhash64(F.lit("walked"), "least").alias("walked")))
    later = _found(nodes.join(walked, "node", "left").withColumn("walked", F.coalesce("walked", "node")), f"block >= {EARLY}", similarity, radius, bucket_rows)
    found = early.unionByName(later)
    crowds = crowds.unionByName(merged(later).withColumn("crowd", F.xxhash64(F.lit("later"), "crowd")))
    once = found.where("u <> v").groupBy("u", "v").agg(F.min("bits").alias("bits"))
    near = F.row_number().over(Window.partitionBy("u").orderBy("bits", "v"))
    wanted = once.withColumn("near", F.when(F.col("bits") < 0, 0).otherwise(near)).where(F.col("near") <= SMALL)
    pairs = materialize(wanted.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def held(wanted: DataFrame) -> DataFrame:
        return node_texts(materialize(wanted.distinct().join(nodes.select("node", "least"), "node")), docs, shingle)

    texts = held(pairs.select(F.explode(F.array("u", "v")).alias("node")))
    one, two = texts.toDF("u", "one"), texts.toDF("v", "two")
    checked = materialize(pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two").mapInArrow(_similar(similarity, shingle), "u long, v long"))
    if crowds.isEmpty():
        return checked
    named = crowds.join(components(checked), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = named.groupBy("least", "crowd").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    left = materialize(named.join(split.select("least", "crowd"), ["least", "crowd"]))
    if left.isEmpty():
        return checked

    def walk(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("node")
        node, fp = run["node"].to_numpy(np.int64), run[["one", "two"]].to_numpy(np.int64).view(np.uint64)
        u, v, _ = _walk(fp, run["size"].to_numpy(np.int64), radius, similarity, list(_sets(pa.array(run["text"], pa.string()), shingle)), run["component"].to_numpy(np.int64))
        return pd.DataFrame({"u": node[u], "v": node[v]}, dtype=np.int64)

    marks = materialize(held(left.select("node")).join(nodes.select("node", "one", "two", "size"), "node"))
    return checked.unionByName(left.join(marks, "node").groupBy("least", "crowd").applyInPandas(walk, "u long, v long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 38, words: int = 8, bucket_rows: int = 2048) -> DataFrame:
    """(doc_id, component_id) of every row with an id."""
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    marked = materialize(_marks(base, shingle, words, *block_sizes(base.count())))
    nodes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("one", "two", "size", "keys")]))
    found = components(similar_links(nodes, base, shingle, similarity, radius, bucket_rows))
    named = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = materialize(named.select("node", "component").join(names, "component").select("node", "component_id"))
    return marked.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose document has its component's smallest id (rows without an id stay)."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = groups.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col].cast("long") == gone["__gone"], "left_anti")
