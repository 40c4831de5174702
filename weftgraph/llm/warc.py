"""WARC archives: writing, reading, and reassembly of segmented records.

Writing. One record per page; the payload is sent in chunked transfer framing inside an HTTP
response, and a block longer than a segment goes on in continuation records. Of pages with equal
payloads of ``min_revisit`` bytes or more the one with the smallest page_id is the response, the
others revisit it. The archives are gzip files of plain WARC/1.1 records, written by Spark's own
writer into the shared folder and so onto any file system it knows.

Reading. Each archive file (bounded by records per file) is parsed record by record by its content
lengths. Whole records are decoded where they are read. Only continuation records and their origins
are shuffled: grouped by origin identifier, ordered by segment number, checked against the total
length, joined and decoded. A group is one page.

Edge cases: a null html is an empty payload; a null page_id has no page field and comes back null
(it revisits if another page has that payload); repeated rows with the smallest page_id are all
responses; a null url is an empty one; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
#: Bytes of a record's block, bytes of a transfer chunk, records of a file.
SEGMENT, CHUNK, RECORDS = 16_384, 4_096, 2_048
DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def frame(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[at : at + chunk] for at in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped, a short body is an error."""
    at, parts = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response, out of its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unframe(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record(block: bytes, **fields: object) -> bytes:
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def records_of(name: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page; ``name`` makes its record identifier unique."""
    own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common_fields = {"WARC_Record_ID": own, "WARC_Target_URI": url, "WARC_Date": DATE, "WARC_Payload_Digest": f"sha256:{digest}", "WARC_Page_ID": page_id}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record(b"", WARC_Type="revisit", **common_fields, WARC_Profile=profile, WARC_Refers_To_Page=refers_to)
        return
    block = _HTTP + frame(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    kind = {"Content_Type": "application/http; msgtype=response"}
    yield record(parts[0], WARC_Type="response", **common_fields, **kind, WARC_Segment_Number=1 if parts[1:] else None)
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        one = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{name}/{k}'.encode()).digest()[:16])}>"
        yield record(part, WARC_Type="continuation", WARC_Record_ID=one, WARC_Date=DATE, WARC_Segment_Origin_ID=own, WARC_Segment_Number=k, WARC_Segment_Total_Length=total)


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields, block) of each record of an archive given in pieces."""
    held = bytearray()

    def more() -> bool:
        piece = next(data, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
        lines = bytes(held[:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        stop = end + 4 + int(fields[b"content-length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError("a block is cut short")
        yield fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a file of one or many gzip members, or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view):
        one = zlib.decompressobj(31)
        at = 0
        while not one.eof and at < len(view):
            yield one.decompress(view[at : at + step])
            at += step
        yield one.flush()
        view = view[min(at, len(view)) - len(one.unused_data) :]


def write(pages: DataFrame, min_revisit: int = MIN_REVISIT, segment: int = SEGMENT) -> str:
    """Write the archives of (page_id, url, html) and return their folder."""
    own = common.narrow(pages).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), common.text_bytes("html").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_revisit
    first = own.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"))
    first = common.materialize(common.fewer_parts(first), "first-pages")
    found = own.join(first, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(stream):
        from pyspark import TaskContext

        nth, part = 0, TaskContext.get().partitionId()
        for big in stream:
            for batch in common.batches(big, 256):
                out = []
                for page_id, url, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    nth += 1
                    out += [r[:-1] for r in records_of(f"{part}/{nth}/{page_id}/{digest}", page_id, url, payload, digest, to, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = found.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(run, "record binary")
    path = common.scratch_path(pages.sparkSession, "warc")
    rows.select(F.col("record").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)
    return path


RECORD = "page_id long, record_type string, payload_digest string, refers_to long, payload binary"
PIECE = "origin string, number int, total long, page_id long, payload_digest string, block binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _number(fields: dict[bytes, bytes], key: bytes) -> int | None:
    return int(fields[key]) if key in fields else None


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """Responses in one record, and revisits (whose payload is null)."""

    def run(stream):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in stream:
            for content in batch.column(0):
                rows: list[tuple] = []
                for f, block in parse(unzipped(content.as_py())):
                    kind = f[b"warc-type"].decode()
                    if kind in ("response", "revisit") and b"warc-segment-number" not in f:
                        digest = f[b"warc-payload-digest"].decode().removeprefix("sha256:")
                        rows.append((_number(f, b"warc-page-id"), kind, digest, _number(f, b"warc-refers-to-page"), payload_of(block) if kind == "response" else None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return _files(spark, path).mapInArrow(run, RECORD)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of segmented blocks, keyed by the origin's identifier."""

    def run(stream):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in stream:
            for content in batch.column(0):
                rows: list[tuple] = []
                for f, block in parse(unzipped(content.as_py())):
                    if b"warc-segment-number" in f:
                        origin = f.get(b"warc-segment-origin-id", f[b"warc-record-id"]).decode()
                        digest = f.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:") or None
                        rows.append((origin, int(f[b"warc-segment-number"]), _number(f, b"warc-segment-total-length"), _number(f, b"warc-page-id"), digest, block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    return _files(spark, path).mapInArrow(run, PIECE)


def reassemble(pieces: DataFrame) -> DataFrame:
    """Responses from segments; a missing segment or another length than the total is an error."""

    def run(stream):
        for big in stream:
            for batch in common.batches(big, 64):
                rows = []
                for page_id, digest, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block = b"".join(p["block"] for p in parts)
                    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                        raise ValueError(f"segments of page {page_id} are not whole")
                    rows.append((page_id, digest, payload_of(block)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["page_id", "payload_digest", "payload"])

    grouped = pieces.groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    found = grouped.drop("origin").mapInArrow(run, "page_id long, payload_digest string, payload binary")
    return found.select("page_id", F.lit("response").alias("record_type"), "payload_digest", F.lit(None).cast("long").alias("refers_to"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, payload_digest, refers_to, payload) of all pages; a revisit's payload
    is null, to be taken from the response with that digest."""
    return whole_records(spark, path).unionByName(reassemble(segments(spark, path)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(common.table(spark, sf_dir, "pages"))
    seen = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    back = read(spark, path).select("page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), seen.alias("payload_digest"))
    back = common.materialize(common.fewer_parts(back), "read-back")
    responses = back.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    known = common.materialize(common.fewer_parts(known), "responses")
    revisits = back.filter("record_type = 'revisit'").drop("payload_bytes").join(known, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS least FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN least <> page_id OR page_id IS NULL THEN least END AS refers_to
FROM q
"""
