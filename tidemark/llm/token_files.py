"""Token files: ids of whole texts in canonical length-limited Huffman code, read back by table.

``write`` encodes every document once (an end id closes it), counts ids over all documents,
makes one code book from the counts, and writes the documents' ids in ascending order of
doc_id. A folder holds three Parquet tables, so that any store Spark reaches can keep it:

    codes   id, bits: the canonical code book, the shortest codes first in id order
    blocks  part, block, start (in its part), n_tokens, doc_ids, ends, marks, stream
    parts   part, start: ids before the part

A block holds whole documents: those that begin within ``block_tokens`` ids. ``stream`` is
their code, most significant bit first; ``marks`` are bits between checkpoints (every 64
ids, unsigned 16-bit); ``ends`` are the documents' last positions in the block, plus one. A
block needs only the code book, and a document in it only the checkpoints around it.

Range partitions follow doc_id and a digest of the ids, so an id that many rows share (or
null) spreads over parts. The code book has at most a row per vocabulary id and ``parts``
one per partition; these two alone reach the driver or all tasks.

Defined results: a null text is an empty one (its end id alone); null ids come first;
repeated ids keep a row each, ordered by the digest of their ids; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import slices
from .chunks import CUT_BYTES, Cache, split, take_runs
from .common import materialize, pick
from .huffman import Book, Decoder, code_lengths

BLOCKS = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("marks", pa.binary()), ("stream", pa.binary())]
)
BLOCK_COLUMNS = "part int, block int, start long, n_tokens long, doc_ids array<long>, ends array<long>, marks binary, stream binary"


@lru_cache(maxsize=2)
def piece_encoder(path: str, kind: str) -> Cache:
    """Piece ids by the tokenizers library; for vocabularies that ``split`` suits."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    whole = Tokenizer.from_file(path)
    merges = whole.model

    def encode(pieces: list[str]) -> list[list[int]]:
        plain = [p.isascii() and p.isalnum() for p in pieces]  # one pre-token in lower case that nothing changes
        others = iter(whole.encode_batch_fast([p for p, k in zip(pieces, plain, strict=True) if not k], add_special_tokens=False))
        return [[t.id for t in merges.tokenize(p)] if k else next(others).ids for p, k in zip(pieces, plain, strict=True)]

    return Cache(encode, kind)


def id_kind(tokenizer: str) -> str:
    """The narrowest unsigned little-endian type of a vocabulary's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (``id_kind`` of the vocabulary, the end id last) of every document."""
    kind = id_kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(tokenizer, kind)
        for batch in batches:
            for lo, hi, _, _ in slices(batch.column(1), CUT_BYTES):
                ids, at = model.rows(*split(batch.column(1).slice(lo, hi - lo)))
                ids = np.insert(ids, at[1:], end_id)
                ends = at + np.arange(len(at))
                data = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ids.itemsize * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(ends)), data], ["doc_id", "n_tokens", "ids"])

    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def flat_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and its rows' offsets in them."""
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    off //= np.dtype(kind).itemsize
    return np.frombuffer(data, kind)[off[0] : off[-1]] if data else np.zeros(0, kind), off - off[0]


def count_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all rows of ``ids``; every task sends one row an id it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            seen = np.bincount(flat_ids(batch.column(0), kind)[0])
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_book(counts: DataFrame, longest: int) -> np.ndarray:
    """Code length of every id; the counts have at most one row per vocabulary id."""
    found = counts.collect()
    total = np.zeros(max((r["id"] for r in found), default=-1) + 1, np.int64)
    for r in found:
        total[r["id"]] = r["n"]
    used = int((total > 0).sum())
    return code_lengths(total, max(longest, (max(used, 2) - 1).bit_length()))


def blocks(tokens: DataFrame, kind: str, lengths: np.ndarray, block_tokens: int) -> DataFrame:
    """Blocks of each partition's documents in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = Book(lengths), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = start = 0

        def flush() -> pa.RecordBatch:
            stream, marks = book.encode(np.concatenate([ids for _, ids in held]))
            row = [part, number, start, size, [i for i, _ in held], np.cumsum([len(ids) for _, ids in held]), np.diff(marks).astype("<u2").tobytes(), stream]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            ids, off = flat_ids(batch.column(1), kind)
            for i, lo, hi in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                held.append((i, ids[lo:hi]))
                size += hi - lo
                if size >= block_tokens:
                    yield flush()
                    held, size, number, start = [], 0, number + 1, start + size
        if held:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.asc("__tie"), F.asc("ids")]
    dealt = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("__tie")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(run, BLOCK_COLUMNS)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", longest: int = 18, block_tokens: int = 1 << 16) -> None:
    """Write ``docs`` as token files into ``folder``. Codes have at most ``longest`` bits, or as many as the used ids need."""
    spark = docs.sparkSession
    tokens = materialize(encode(docs, tokenizer, end_id, id_col, text_col))
    kind = id_kind(tokenizer)
    lengths = code_book(count_ids(tokens, kind), longest)
    codes = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(codes, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    blocks(tokens, kind, lengths, block_tokens).write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = _table(spark, folder, "blocks", BLOCK_COLUMNS).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{folder}/parts")


def _table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(f"{folder}/{name}")


def read_lengths(spark: SparkSession, folder: str) -> np.ndarray:
    """The code book: code length of every id."""
    rows = _table(spark, folder, "codes", "id long, bits int").collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        out[r["id"]] = r["bits"]
    return out


def read(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids of the documents in ``folder``.

    With ``wanted`` only those documents; blocks without them are skipped, and in the others
    only the stretches between the checkpoints around them are decoded.
    """
    lengths = read_lengths(spark, folder)
    only = None if wanted is None else set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                marks = np.concatenate([[0], np.cumsum(np.frombuffer(row["marks"], "<u2"), dtype=np.int64)])
                ends = np.array(row["ends"])
                starts = np.concatenate([[0], ends[:-1]])
                which = np.arange(len(ends)) if only is None else np.array([k for k, i in enumerate(row["doc_ids"]) if i in only], np.int64)
                if not len(which):
                    continue
                lo = int(starts[which[0]])
                ids = decoder.decode(row["stream"], marks, row["n_tokens"], lo, int(ends[which[-1]]))
                at, off = take_runs(np.concatenate([[0], ends]), which)
                data = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(ids[at - lo].astype("<u4"))])
                doc_ids = pa.array([row["doc_ids"][k] for k in which], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(row["start"] + starts[which]), pa.array(np.diff(off)), data], ["doc_id", "start", "n_tokens", "ids"])

    stored = _table(spark, folder, "blocks", BLOCK_COLUMNS)
    if wanted is not None:
        stored = stored.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in only])))
    parts = _table(spark, folder, "parts", "part int, start long").withColumnRenamed("start", "before")
    placed = stored.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("before"))
    return placed.select("start", "n_tokens", "doc_ids", "ends", "marks", "stream").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
