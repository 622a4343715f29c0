"""Token counts of sections from one encoding of the whole document.

A document is encoded once. The vocabulary is byte-level, so token lengths add up to byte
offsets, and tokens are joined to sections by interval. Sections are the text's lines, each
with the newline that ends it, or any given cut of the text into consecutive parts.

Rule for a token over a boundary: ``first`` (the section that holds its first byte),
``last`` (its last byte), or ``split`` (to each by its share of the token's bytes). With
``first`` and ``last`` counts are whole; with each rule the sections' counts add up to the
document's tokens.

Defined results: a null or empty text has one empty section without tokens; empty lines are
sections; repeated ids keep their own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .tokens import encoder

COUNTS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("first_char", pa.int64()), ("end_char", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])


def lines(text: str) -> list[int]:
    """Ends of the lines (in characters), each with its newline."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return ends.tolist()


def attribute(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those that cross its end; both cuts in bytes."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    n = len(ends)
    crossing = np.bincount(first[last > first], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    count = np.bincount(first[first == last], minlength=n).astype(float)
    for t in np.flatnonzero(last > first):
        edges = np.concatenate([[start[t]], ends[first[t] : last[t]], [stop[t]]])
        count[first[t] : last[t] + 1] += np.diff(edges) / lengths[t]
    return count, crossing


def count_sections(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", sections: Callable[[str], list[int]] = lines) -> DataFrame:
    """Per document and section: doc_id, section, first_char, end_char, n_tokens, n_crossing."""
    if rule not in ("first", "last", "split"):
        raise ValueError(f"unknown rule {rule}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ranks, pattern)
        size = model.token_bytes
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                out: list[list] = [[] for _ in COUNTS]
                for i, text, ids in zip(batch.column(0).to_pylist(), texts, model.ids(texts), strict=True):
                    ends = sections(text)
                    if text.isascii():
                        cuts = np.array(ends)
                    else:
                        at_char = np.flatnonzero((np.frombuffer(raw := text.encode(), np.uint8) & 0xC0) != 0x80)
                        cuts = np.append(at_char, len(raw))[ends]
                    counts, crossing = attribute(size[ids], cuts, rule)
                    out[0] += [i] * len(ends)
                    out[1] += range(len(ends))
                    out[2] += [0, *ends[:-1]]
                    out[3] += ends
                    out[4] += counts.tolist()
                    out[5] += crossing.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, COUNTS, strict=True)], schema=COUNTS)

    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, section int, first_char long, end_char long, n_tokens double, n_crossing long")
