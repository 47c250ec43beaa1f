"""Media columns of interleaved documents: HTML becomes an ordered sequence of texts and media references, and a join on
digests resolves the references in a store of payloads.

interleave() keeps the order of the page: paragraphs and other blocks are texts of their own, position counts texts and
references alike, and a reference carries its caption (that of its figure, or else its alternative text), so that texts,
media and captions stay aligned through the join. A payload is stored as an 8-bit grey image (PNG: lossless, rows of
`width` samples); the store is addressed by the digest of the payload, so that equal payloads are equal rows, whichever
task wrote them. Features are computed from the samples that are read back where they lie; digests and features travel,
payloads don't. Only references are joined, so that texts, which have no digest, don't meet in one task.

Defined results: a null html gives no items; a null text is an empty payload, which is stored as one row of zeros; a
reference whose digest isn't in the store keeps its place with nulls; equal rows each have their sequence; of two
captions of a figure both count, joined by a space; a very long text is parsed and stored whole; a page's column `items`
gives way to the sequence, and one named like a column of the items or of the store is told as page_<name>; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import encoded, new_path, slices, stored

WIDTH = 64
#: The signature that opens a PNG file: a fixed value.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
DIGEST = re.compile(r"sha256:([0-9a-f]{64})")
MEDIA = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
#: Characters of a document's caption.
CAPTION = 60
ITEM = "position int, kind string, text string, digest string, caption string"
_FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey image of the payload, whose length is a multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    data = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with filter 0, none
    data[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image without row filters, as rows."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's check sum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't supported")
    return np.ascontiguousarray(rows[:, 1:])


class _Interleaver(HTMLParser):
    """Collects the texts and references of a page in their order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = self.depth = 0
        self.figures: list[tuple[int, list[str]]] = []
        self.caption = False

    def flush(self) -> None:
        if text := " ".join(" ".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS and not self.caption:
            self.flush()
        elif tag == "figure":
            self.flush()
            self.figures.append((len(self.items), []))
        elif tag == "figcaption" and self.figures:
            self.flush()
            self.caption = True
        elif tag in MEDIA:
            self.flush()
            of = dict(attrs)
            found = DIGEST.search(of.get("src") or of.get("data-digest") or "")
            self.items.append({"kind": "media", "text": None, "digest": found[1] if found else None, "caption": of.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS and not self.caption:
            self.flush()
        elif tag == "figcaption":
            self.caption = False
            if self.figures:
                self.figures[-1][1].append(" ")
        elif tag == "figure" and self.figures:
            self.flush()
            begin, words = self.figures.pop()
            if said := " ".join(" ".join(words).split()):
                for x in self.items[begin:]:
                    if x["kind"] == "media":
                        x["caption"] = said

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.figures[-1][1] if self.caption and self.figures else self.words).append(data)


def items_of(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    parser = _Interleaver()
    parser.feed(html or "")
    parser.close()
    while parser.figures:
        parser.handle_endtag("figure")
    parser.flush()
    return [{"position": i, **x} for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without column html, with the items of each page in column items."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html, "items")]
    struct_of = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array([items_of(x) for x in batch.column("html").to_pylist()], struct_of)], ["rest", "items"])

    rows = pages.select(F.struct(*rest, F.lit(None).cast("int").alias("items")).alias("rest"), F.col(f"`{html}`").cast("string").alias("html"))
    schema = T.StructType([rows.schema["rest"], T.StructField("items", T.ArrayType(T.StructType.fromDDL(ITEM)))])
    found = rows.mapInArrow(parsed, schema)
    return found.select(*[found["rest"][c].alias(c) for c in pages.columns if c not in (html, "items")], "items")


def padded(text: Column, width: int = WIDTH) -> Column:
    """A text's UTF-8 bytes with zeros up to a positive multiple of width."""
    data = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.octet_length(data)
    return F.concat(data, F.encode(F.repeat(F.lit("\0"), F.when(n == 0, width).otherwise(F.pmod(-n, F.lit(width)))), "utf-8"))


def store(payloads: DataFrame) -> str:
    """Writes payloads (binary column payload) as images in a new folder of the shared one; gives its path. The rows are
    digest and media."""
    path = new_path(payloads.sparkSession, "media")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                found = {hashlib.sha256(x).hexdigest(): x for x in encoded(batch.column("payload")) if x is not None}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([to_png(x) for x in found.values()], pa.binary())], ["digest", "media"])

    payloads.select("payload").mapInArrow(written, "digest string, media binary").write.option("compression", "uncompressed").parquet(path)
    return path


def described(samples: np.ndarray) -> str:
    """A media feature: size, mean, deviation and entropy of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / samples.size
    mean = float((counts * np.arange(256)).sum() / samples.size)
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / samples.size))
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.3f};std={spread:.3f};entropy={0.0 - (p * np.log2(p)).sum():.3f}"


def features(media: DataFrame) -> DataFrame:
    """digest and what is computed from the stored bytes of each of its images; one row for each digest."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for digest, image in zip(batch.column("digest").to_pylist(), encoded(batch.column("media")), strict=True):
                    samples = from_png(image)
                    payload = samples.tobytes()
                    if (sha := hashlib.sha256(payload).hexdigest()) != digest:
                        raise ValueError(f"the payload stored as {digest} has another digest")
                    rows.append((digest, len(payload), sha, zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), described(samples)))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in _FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    found = media.mapInArrow(computed, _FEATURES)
    rest = [x.split()[0] for x in _FEATURES.split(", ")][1:]
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in rest])


def resolve(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each item of interleave()'s rows, in place of items: position, kind, text, digest, caption, and the columns
    that `known` has by digest, null for texts and for references that it lacks."""
    item = [f.name for f in sequences.schema["items"].dataType.elementType]
    more = [c for c in known.columns if c != "digest"]
    taken = {c.lower() for c in (*item, *more)}
    own = {c: f"page_{c}" if c.lower() in taken else c for c in sequences.columns if c != "items"}
    flat = sequences.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.explode("items").alias("_item"))
    page = [F.col(f"`{n}`") for n in own.values()]
    flat = flat.select(*page, *[F.col("_item")[c].alias(c) for c in item])
    referring = flat.where("digest is not null").join(known, "digest", "left").select(*page, *item, *more)
    return referring.unionByName(flat.where("digest is null").select("*", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in more]))


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def as_page(text: Column, digest: Column) -> Column:
    """A document's text as HTML: a paragraph for each line that isn't blank, and after the first half of them a figure that
    refers to the payload of `digest`; its caption is the beginning of the paragraph before it."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\s\x00-\x1f]"))
    half = F.ceil(F.size(lines) / 2).cast("int")
    paragraph = lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))
    part = lambda xs: F.array_join(F.transform(xs, paragraph), "")
    caption = F.substring(F.coalesce(F.get(lines, half - 1), F.lit("")), 1, CAPTION)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), escaped(caption), F.lit("</figcaption></figure>"))
    return F.concat(part(F.slice(lines, F.lit(1), half)), figure, part(F.slice(lines, half + 1, F.size(lines))))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_items, position,
    caption of each document: its paragraphs with its whole text between them as a media payload, which is stored, resolved
    in its place and read back."""
    payload = padded(F.col("text"))
    path = store(docs.select(payload.alias("payload")))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    pages = docs.select("doc_id", n.alias("n_bytes"), as_page(F.col("text"), F.sha2(payload, 256)).alias("html"))
    known = stored(features(docs.sparkSession.read.schema("digest string, media binary").parquet(path)), "media-features")
    sequences = interleave(pages).select("doc_id", "n_bytes", F.size("items").cast("long").alias("n_items"), F.filter("items", lambda x: x["kind"] == "media").alias("items"))
    rows = resolve(sequences, known)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")
