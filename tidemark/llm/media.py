"""Interleaved document sequences with media resolved by digest.

A document is HTML. Parsing gives its ordered parts: texts and media references, each with
its position, and a figure's caption beside its image. Media lie in a content-addressed
table (digest, media); references name a digest, and a join on it resolves them. Features
are computed from the stored bytes, once per digest and task.

The stored form of a byte payload is a grey-scale portable graymap: 64 samples of 8 bits a
row, after the header. Payloads are padded with zero bytes to a positive multiple of 64, so
the form is lossless.

Defined results: a null text is an empty payload; equal payloads have equal digests and
features; a reference whose digest is not in the table keeps its place with null features;
repeated ids keep their own rows; null or empty HTML has no parts. A caption ends with its
figure or the page if its own end is missing; a caption without media, or outside any figure, is text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

WIDTH = 64
SCHEME = "media:"
_BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "blockquote", "pre", "nav", "header", "footer", "body", "html", "title", "main", "aside"}
_HIDDEN = {"script", "style", "template"}


class _Parts(HTMLParser):
    """Texts and media in order. Open figures are a stack; a figure's caption goes to the media it holds when it ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []

    def flush(self) -> None:
        said, self.text = " ".join("".join(self.text).split()), []
        if not said:
            return
        if self.figures and self.figures[-1]["open"]:
            self.figures[-1]["caption"].append(said)
        else:
            self.parts.append({"position": len(self.parts), "kind": "text", "text": said, "digest": None, "caption": None})

    def end_caption(self) -> None:
        self.flush()
        if self.figures:
            self.figures[-1]["open"] = False

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        said = " ".join(figure["caption"])
        if said and figure["media"]:
            for k in figure["media"]:
                self.parts[k]["caption"] = said
        elif said:  # nothing to caption: it is text
            self.text.append(said)
            self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source", "embed"):
            source = dict(attrs).get("src") or ""
            if source:
                self.flush()
                self.parts.append({"position": len(self.parts), "kind": "media", "text": None, "digest": source.removeprefix(SCHEME), "caption": dict(attrs).get("alt")})
                if self.figures:
                    self.figures[-1]["media"].append(len(self.parts) - 1)
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "caption": [], "open": False})
            elif tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = True

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()
        return self.parts


def parts(html: str | None) -> list[dict]:
    """Ordered texts and media references of one HTML document."""
    parser = _Parts()
    parser.feed(html or "")
    return parser.finish()


def sequences(docs: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row per part: doc_id, position, kind, text, digest, caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["position", "kind", "text", "digest", "caption"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(i, p) for i, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in parts(html)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64())] + [pa.array([p[n] for _, p in rows], k) for n, k in zip(names, kinds, strict=True)], names=["doc_id", *names])

    base = pick(docs, doc_id=id_col, html=html_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, position int, kind string, text string, digest string, caption string")


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the padded bytes of a text."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def store_form(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def samples_of(media: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a stored graymap."""
    kind, size, depth, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not a stored graymap")
    return width, height, rest


FEATURES = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_features(media: DataFrame) -> DataFrame:
    """Features of the stored rows (digest, media), from the bytes as read; a task leaves repeats of a digest out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_before: set[str] = set()
        for batch in batches:
            out: list[list] = [[] for _ in FEATURES]
            for digest, blob in zip(batch.column(0), batch.column(1), strict=True):
                if digest.as_py() in seen_before:
                    continue
                seen_before.add(digest.as_py())
                blob = blob.as_py()
                width, height, samples = samples_of(blob)
                seen = np.frombuffer(samples, np.uint8)
                edges = np.bincount(seen >> 4, minlength=16)
                feature = f"{width}x{height} mean {seen.mean():.4f} deviation {seen.std():.4f} sixteenths {','.join(map(str, edges.tolist()))}"
                values = (digest.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), feature)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FEATURES, strict=True)], schema=FEATURES)

    kinds = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "media").mapInArrow(run, kinds)


def resolve(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """Parts of ``sequences`` with the features of the media they reference.

    A digest's features are made once in each task that holds it, then one row a digest is
    kept and written: moving the bytes to make them once in all would cost more than reading
    them. So the join has two plain sides and a digest that many documents share can be split
    at run time.
    """
    once = media_features(media)
    once = once.groupBy("digest").agg(*[F.first(c).alias(c) for c in once.columns[1:]])
    return parsed.join(materialize(once), "digest", "left")


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media inside an HTML document that references it: doc_id, html, digest, media.

    The caption holds the unpadded length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                html, digests, media = [], [], []
                for text in batch.column(1).to_pylist():
                    n, samples = payload(text)
                    media.append(store_form(samples))
                    digests.append(hashlib.sha256(media[-1]).hexdigest())
                    html.append(f'<article><figure><img src="{SCHEME}{digests[-1]}"><figcaption>{n} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])

    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return materialize(base.mapInArrow(run, "doc_id long, html string, digest string, media binary"))
