"""Media columns: interleaved document sequences with payloads resolved by digest.

``sequences`` parses HTML into an ordered array of text and media-reference structs; ``store``
encodes payloads as grayscale PNG (one byte a sample, zlib without loss), keyed by the payload's
SHA-256; ``read_back`` decodes the stored bytes and computes features of them; ``resolve`` joins
references to what the store holds, by digest, keeping position and caption with their reference.

Payload bytes never cross the network: the store is written where the text is read, replicas of a
digest from different tasks are equal, and only digests and features are shuffled. The features of
a digest are a written table, so the join's sides are plain exchanges and a digest that a third of
all references share is split by adaptive execution.

Edge cases: a null text or page is empty (the padded payload is then 576 bytes of 255; the
sequence has no items); HTML that no parser would take is text; equal texts have equal values in all columns; a reference whose digest the
store lacks stays, with nulls; null ids and repeated rows stay as rows of their own; empty tables
give no rows; further columns are ignored; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, PAD, TAIL, GRID = 576, 255, 32, 8
ITEM = "struct<position:int,kind:string,text:string,digest:string,src:string,caption:string>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SKIPPED = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "table", "figure", "blockquote", "pre", "title", "nav", "header", "footer", "body"}
_MEDIA = {"img", "video", "audio", "source", "embed"}


class Interleaver(HTMLParser):
    """Texts and media references in document order; a figure's caption goes to its last reference,
    else to the alt or title attribute."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure, self.skipped = -1, 0

    def flush(self) -> None:
        text, self.words = " ".join("".join(self.words).split()), []
        if text:
            self.items.append(["text", text, None, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped += 1
        if tag == "figcaption" and self.caption is None:
            self.flush()
            self.caption = []
        elif tag in _BLOCKS or tag in _MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag in _MEDIA:
            a = dict(attrs)
            self.items.append(["media", None, a.get("data-digest"), a.get("src"), a.get("alt") or a.get("title")])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            own = [x for x in self.items[max(0, self.figure) :] if x[0] == "media"]
            if own:
                own[-1][4] = text or own[-1][4]
            elif text:
                self.items.append(["text", text, None, None, None])
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = -1

    def handle_data(self, data):
        if not self.skipped:
            (self.words if self.caption is None else self.caption).append(data)


    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section that is none: a comment up to the next >
            at = self.rawdata.find(">", i)
            return at + 1 if at >= 0 else len(self.rawdata)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def interleave(html: str | None) -> list[dict]:
    parser = Interleaver()
    try:
        parser.feed(html or "")
        parser.close()
    except AssertionError:  # whatever else the parser takes to be impossible: what is left is text
        parser.handle_data(parser.rawdata)
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser.flush()
    names = ("kind", "text", "digest", "src", "caption")
    return [{"position": k} | dict(zip(names, x, strict=True)) for k, x in enumerate(parser.items)]


def sequences(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """The columns ``keep`` and ``items``: the page's texts and media references in order."""
    out = common.narrow(pages).select(*keep, F.col(html).alias("html"))

    def run(stream):
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "src", "caption"))]))
        for big in stream:
            for batch in common.batches(big):
                items = pa.array([interleave(x) for x in batch.column("html").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), items], names=[*keep, "items"])

    fields = ", ".join(f"`{k}` {dict(out.dtypes)[k]}" for k in keep)
    return out.mapInArrow(run, f"{fields}, items array<{ITEM}>")


def encode(payload: bytes) -> bytes:
    """Grayscale PNG, 576 samples a row; the payload's length must be a positive multiple of that."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each row after its filter byte
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """Samples, one row of the image a row; checks every chunk's sum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data = 8, None, []
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's sum differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grayscale image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("rows with a filter")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """64 bits as hex: of an 8 x 8 grid of cells, those brighter than the mean of all cells."""
    height, width = samples.shape
    top = np.arange(GRID) * height // GRID
    sums = np.add.reduceat(samples.reshape(height, GRID, width // GRID).sum(2, dtype=np.int64), top, axis=0)
    cells = sums / np.maximum(np.diff(np.r_[top, height]), 1)[:, None]
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def padded(text: Column | str) -> Column:
    """UTF-8 bytes and bytes 255 up to a positive multiple of the width."""
    data = common.text_bytes(text)
    fill = F.when(F.octet_length(data) == 0, F.lit(WIDTH)).otherwise(F.pmod(-F.octet_length(data), F.lit(WIDTH)))
    return F.concat(data, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), fill)))


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media) written in the shared folder, from (digest, payload). A task stores a digest
    it has stored lately only once."""

    def run(stream):
        for big in stream:
            known: set[str] = set()
            for batch in common.batches(big, 512):
                rows = [(d, encode(p)) for d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) if not (d in known or known.add(d))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.binary())], names=["digest", "media"])

    return common.materialize(common.narrow(payloads).select("digest", "payload").mapInArrow(run, "digest string, media binary"), "media")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """One row per stored digest, all of it computed from the stored bytes."""

    def run(stream):
        for big in stream:
            for batch in common.batches(big, 512):
                rows = []
                for digest, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    samples = decode(stored)
                    payload = samples.tobytes()
                    rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (1, 3, 4) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in FEATURES.split(", ")])

    found = media.select("digest", "media").mapInArrow(run, FEATURES)
    return common.materialize(found.groupBy("digest").agg(*(F.first(x.split()[0]).alias(x.split()[0]) for x in FEATURES.split(", ")[1:])), "features")


def resolve(found: DataFrame, features: DataFrame, *keep: str) -> DataFrame:
    """A row per media reference: the columns ``keep``, position, digest, caption and what the store
    has under that digest."""
    refs = found.select(*keep, F.explode("items").alias("item")).filter("item.kind = 'media'")
    refs = refs.select(*keep, "item.position", "item.digest", "item.caption")
    return refs.join(features, "digest", "left")


def page(text: Column, digest: Column, caption: Column) -> Column:
    """An article of the text's lines and, after the middle one, a figure with the digest's image."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\0", "\ufffd")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    lines = F.split(F.coalesce(text, F.lit("")), "[\n\r]+")
    half = F.floor(F.size(lines) / 2).cast("int")
    part = lambda of: F.concat(F.lit("<p>"), F.array_join(of, "</p><p>"), F.lit("</p>"))
    figure = F.concat(F.lit("<figure><img data-digest='"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), part(F.slice(lines, F.lit(1), half)), figure, part(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: its text's lines as paragraphs, and after the middle one its bytes as a
    captioned image, so that the image's position is the number of paragraphs before it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(common.text_bytes("text")).cast("long").alias("n_bytes"), padded("text").alias("payload"))
    docs = docs.withColumn("digest", F.sha2("payload", 256))
    pages = docs.select("doc_id", "n_bytes", page(F.col("text"), F.col("digest"), F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes"))).alias("html"))
    features = read_back(store(docs))
    out = resolve(sequences(pages, "doc_id", "n_bytes"), features, "doc_id", "n_bytes")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
