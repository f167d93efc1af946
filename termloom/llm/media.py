"""Operator 3: media columns - interleaved document sequences with resolved payloads.

An HTML document is parsed into an ordered sequence of structs: text, and
references to media (digest or address, caption). Payloads live in a table of
their own, stored as lossless 8-bit grey images (PNG, 64 samples a row) by digest;
a digest join resolves the references, and positions and captions stay aligned
because they travel in the reference's row.

At scale: parsing and encoding are maps. The media table is written where it is
made and read back from there; only digests and small feature rows are shuffled,
never payloads. The features of equal payloads are pre-aggregated by digest before
the shuffle, and the join may be split where a digest is hot. Batches are cut by
bytes, so a very long text is alone in its batch.

Defined results: null text is empty and its payload is 64 zero bytes; null or
empty html gives no segments; a reference without a payload keeps its row with
null features; repeated rows each get theirs; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Samples in an image row; payloads are padded to whole rows.
ROW = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"
_SKIP = {"script", "style", "template", "noscript"}
_MEDIA = {"img", "video", "audio", "source"}


def payload_of(raw: bytes) -> bytes:
    """The bytes, padded with zeros to a positive multiple of 64."""
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_media(payload: bytes) -> bytes:
    """An 8-bit grey PNG of 64 columns that holds the payload as samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_media(media: bytes) -> bytes:
    """The samples of an image that ``to_media`` wrote."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, size = 8, b"", (0, 0)
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Shape, mean, spread and a 64-bit difference hash of an 8 x 9 thumbnail, in exact sums."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.linspace(0, len(x), 9).astype(int)
    columns = np.linspace(0, ROW, 10).astype(int)
    lo = np.minimum(lines[:-1], len(x) - 1)
    hi = np.minimum(np.maximum(lines[1:], lines[:-1] + 1), len(x))
    bands = np.stack([x[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(lo, hi, strict=True)])
    box = np.add.reduceat(bands, columns[:-1], axis=1)
    mean = box / ((hi - lo)[:, None] * np.diff(columns)[None, :])
    bits = np.packbits((mean[:, 1:] > mean[:, :-1]).ravel()).tobytes().hex()
    n, total, squares = x.size, 0, 0
    for first in range(0, len(x), 1 << 14):
        part = x[first : first + (1 << 14)].astype(np.int64)
        total += int(part.sum())
        squares += int((part * part).sum())
    spread = math.sqrt((n * squares - total * total) / (n * n))
    return f"{ROW}x{len(x)}:{total / n:.4f}:{spread:.4f}:{bits}"


class _Sequence(HTMLParser):
    """Ordered (kind, text, ref, caption) of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self._text: list[str] = []
        self._hidden = 0
        self._caption: list[str] | None = None
        self._figure: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self._hidden += 1
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                if self._figure:
                    self._figure.append(len(self.out))
                self.out.append(["media", None, a["src"], a.get("alt") or None])
        elif tag == "figure":
            self.flush()
            self._figure = [-1]
        elif tag == "figcaption":
            self.flush()
            self._caption = []
        elif tag in {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "ul", "ol", "section", "article", "blockquote", "pre"}:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in _SKIP:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "figcaption" and self._caption is not None:
            words = " ".join("".join(self._caption).split())
            self._caption = None
            for i in self._figure[1:]:
                self.out[i][3] = words or self.out[i][3]
        elif tag == "figure":
            self.flush()
            self._figure = []
        elif tag in {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "blockquote", "pre"}:
            self.flush()

    def handle_data(self, data):
        if not self._hidden:
            (self._text if self._caption is None else self._caption).append(data)


def parse_html(html: str | None) -> list[tuple]:
    """(kind, text, ref, caption) in document order; a figure's caption goes with its media."""
    if not html:
        return []
    p = _Sequence()
    p.feed(html)
    p.close()
    if p._caption is not None:
        p.handle_endtag("figcaption")
    p.flush()
    return [tuple(x) for x in p.out]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_html(x) for x in batch.column(1).to_pylist()]
        n = [len(r) for r in rows]
        flat = [x for r in rows for x in r]
        kind, text, ref, caption = zip(*flat, strict=True) if flat else ([], [], [], [])
        take = pa.array(np.repeat(np.arange(len(rows)), n))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate([np.arange(k) for k in n]) if n else [], pa.int32()), *[pa.array(x, pa.string()) for x in (kind, text, ref, caption)]], ["key", "position", "kind", "content", "ref", "caption"])


def interleave(pages: DataFrame) -> DataFrame:
    """(key, position, kind, content, ref, caption) of ``pages(key, html)``."""
    c.small_batches(pages.sparkSession)
    key = pages.schema["key"].dataType.simpleString()
    return pages.select("key", "html").mapInArrow(_parsed, f"key {key}, position int, kind string, content string, ref string, caption string")


_MEDIA_TABLE = "digest string, media binary"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, media, size, seen = [], [], 0, set()
        for raw in batch.column(0):
            raw = raw.as_py() or b""
            digest = hashlib.sha256(raw).hexdigest()
            if digest in seen:
                continue
            seen.add(digest)
            digests.append(digest)
            media.append(to_media(payload_of(raw)))
            size += len(media[-1])
            if size > c.BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["digest", "media"])
                digests, media, size = [], [], 0
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["digest", "media"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0), batch.column(1), strict=True):
            media = media.as_py()
            back = from_media(media)
            rows.append((digest.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _FEATURES.split(", ")])


def store_payloads(blobs: DataFrame) -> DataFrame:
    """The media table of ``blobs(raw)``: (digest, media), written and read back; a digest may be in it more than once, with equal media."""
    c.small_batches(blobs.sparkSession)
    return c.materialize(blobs.select("raw").mapInArrow(_stored, _MEDIA_TABLE), "media")


def described(media: DataFrame) -> DataFrame:
    """One row of features per digest, from the stored bytes of ``media(digest, media)``."""
    c.small_batches(media.sparkSession)
    return media.select("digest", "media").mapInArrow(_read_back, _FEATURES).dropDuplicates(["digest"])


def resolve(sequence: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each segment with the features of the payload that its ``sha256:`` reference names (one row per digest)."""
    digest = F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64))
    return sequence.withColumn("digest", digest).join(payloads, "digest", "left")


def page_of(text: Column) -> Column:
    """A document as a page: its text as a paragraph, then a figure with its bytes as payload and their number as caption."""
    raw = text.cast("binary")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.concat(F.lit("<p>"), text, F.lit('</p><figure><img src="sha256:'), F.sha2(raw, 256), F.lit('"><figcaption>'), F.octet_length(raw).cast("string"), F.lit("</figcaption></figure>"))


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sequence = interleave(docs.select(F.col("doc_id").alias("key"), page_of(text).alias("html")))
    # A table of its own, so that a hot digest can be split in the join.
    features = c.materialize(described(store_payloads(docs.select(text.cast("binary").alias("raw")))), "features")
    found = resolve(sequence.where("kind = 'media'"), features)
    return found.select(F.col("key").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), *[x.split()[0] for x in _FEATURES.split(", ")[1:]], "position")


def page_sequences(spark, sf_dir: str) -> DataFrame:
    """The sequences of the raw web pages: (page_id, position, kind, content, ref, caption)."""
    pages = c.table(spark, sf_dir, "pages")
    return interleave(pages.select(F.col("page_id").alias("key"), "html")).withColumnRenamed("key", "page_id")
