"""WARC archives of pages: records in segments with chunked framing, written as files and put together again.

write() gives each page a record: `response`, or, for a payload that another page has too, `revisit` of the response with
the largest page_id. A block over the segment size goes on in `continuation` records that carry their origin's
identifier, a segment number and, on the last, the total length. Payloads are in HTTP's chunked transfer framing. The
records are rows of bytes, which Spark's text writer ends with the two line breaks that close a WARC record, so that any
file system Spark writes to holds gzipped WARC files, each of few records.

read() takes archives from any writer of plain or gzipped WARC 1.0 or 1.1: it walks the records of each file by their
Content-Length as they come out of decompression, groups segments by origin, orders them by number, verifies the total
length, decodes the framing and verifies the payload's digest. Records that are whole are decoded where they are read,
each file once; only segmented ones are shuffled. A file is one row of Spark's reader, so archives should stay under a few
hundred MB, as write()'s are.

Defined results: a null html is an empty payload; all rows that share the largest page_id of a payload are responses;
a null page_id never is a revisit's target unless all of a payload's are null, in which case all are responses; a very
long payload goes through many segments and is held whole by the task that puts it together; columns other than page_id,
url and html are ignored, whatever they are called; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, stored

END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGES = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int"
_READ = f"{_PAGES}, origin string, number int, total long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = framed.index(END, at)
        size = int(framed[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(framed[line + 2 : line + 2 + size])
        if len(out[-1]) != size or framed[line + 2 + size : line + 4 + size] != END:
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + END


def records(key: str, kind: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, target: str | None, chunk: int, segment: int) -> list[bytes]:
    """The records of a page without the line breaks that close them."""
    uri = "".join(c for c in url if c >= " ") or "about:blank"
    block = HTTP.replace(b"Transfer-Encoding: chunked\r\n", b"") if kind == "revisit" else HTTP + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    own = f"<urn:contigra:{key}>"
    out = []
    for n, part in enumerate(parts, 1):
        last = n == len(parts)
        fields = [("WARC-Type", kind if n == 1 else "continuation"), ("WARC-Record-ID", own if n == 1 else f"<urn:contigra:{key}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri)]
        if n == 1:
            fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", page_id)]
        if kind == "revisit":
            fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", target), ("X-Refers-To-Page-ID", refers_to)]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own if n > 1 else None), ("WARC-Segment-Total-Length", len(block) if n > 1 and last else None)]
        out.append(header([*fields, ("Content-Length", len(part))]) + part)
    return out


def write(pages: DataFrame, path: str, least: int = 0, chunk: int = 4096, segment: int = 16384, file_records: int = 1024) -> None:
    """Archives of pages (page_id, url, html) in folder `path`. Equal payloads of at least `least` bytes have one response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit("")) if "url" in pages.columns else F.lit("")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    first = p.select("sha", "page_id").where(F.octet_length("html") >= least) if least else p.select("sha", "page_id")
    first = first.groupBy("sha").agg(F.max("page_id").alias("response"))
    both = p.join(first, "sha", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull(), F.col("response"))
    # equal rows get names of their own from their place in the write
    rows = both.select("page_id", "url", F.encode("html", "utf-8").alias("html"), refers.alias("refers_to"), F.col("sha"), F.uuid().alias("key"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                out: list[bytes] = []
                for r in batch.to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    target = None if r["refers_to"] is None else f"<urn:contigra:payload:{r['sha']}>"
                    out += records(r["key"], kind, r["page_id"], r["url"], r["html"], r["refers_to"], target, chunk, segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # a record's line breaks are the separator's
    lines = rows.mapInArrow(made, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in parts; of a gzipped one, of any number of members, what they hold."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        part = data[at : at + step]
        while part:
            yield member.decompress(part)
            part = member.unused_data
            if member.eof:
                member = zlib.decompressobj(31)
        at += step


def walked(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, whose bytes come in parts."""
    held, at = bytearray(), 0

    def more() -> bool:
        for part in parts:
            if part:
                held.extend(part)
                return True
        return False

    while True:
        if at > 1 << 20:
            del held[:at]
            at = 0
        while len(held) - at < 2 and more():
            pass
        if len(held) == at:
            return
        if held[at : at + 2] == END:
            at += 2
            continue
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("a record's header is cut short")
        version, *lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record begins where {version[:40]!r} stands")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError("a record's block is cut short")
        yield fields, bytes(held[end + 4 : stop])
        at = stop


def decoded(row: dict, blocks: list[bytes]) -> dict:
    """A page of its first record's fields and the blocks of its segments in order."""
    block = b"".join(blocks)
    if row["total"] is not None and row["total"] != len(block):
        raise ValueError(f"segments of {row['origin']} have {len(block)} bytes, not {row['total']}")
    head, _, body = block.partition(b"\r\n\r\n")
    payload = None
    if row["type"] == "response":
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if row["digest"] and digest_of(payload) != row["digest"]:
            raise ValueError(f"the payload of {row['origin']} isn't that of its digest")
    return {"page_id": row["page_id"], "payload": payload, "payload_bytes": None if payload is None else len(payload), "payload_digest": row["digest"], "record_type": row["type"], "refers_to": row["refers_to"], "n_segments": len(blocks)}


def _batch(rows: list[dict], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in names.split(", ")]))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to, n_segments of each page in the archives.
    A revisit's payload is null and its length is its response's. payloads: without them payload is null, once it is
    verified; then each file is read once, and what is found is kept as a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def told(row: dict) -> dict:
        return row if payloads else row | {"payload": None}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in walked(inflated(content.as_py())):
                    own = {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "number": number(f.get("warc-segment-number")), "total": number(f.get("warc-segment-total-length"))}
                    page = {"type": f["warc-type"], "page_id": number(f.get("x-page-id")), "refers_to": number(f.get("x-refers-to-page-id")), "digest": f.get("warc-payload-digest", ":").partition(":")[2] or None}
                    if own["number"] is None:
                        rows.append(told(decoded(own | page, [block])))
                    else:
                        rows.append({"page_id": page["page_id"], "record_type": page["type"], "refers_to": page["refers_to"], "payload_digest": page["digest"], "block": block, **own})
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, _READ)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _READ)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts, origin = batch.column("parts")[i].as_py(), batch.column("origin")[i].as_py()
                if [x["number"] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
                    raise ValueError(f"segments are missing or doubled: {origin}")
                first = parts[0]
                row = {"origin": origin, "total": parts[-1]["total"], "type": first["record_type"], "page_id": first["page_id"], "refers_to": first["refers_to"], "digest": first["payload_digest"]}
                yield _batch([told(decoded(row, [x["block"] for x in parts]))], _PAGES)

    rows = files.mapInArrow(parsed, _READ)
    rows = rows if payloads else stored(rows, "warc-records")
    cols = [x.split()[0] for x in _PAGES.split(", ")]
    part = F.struct("number", "total", "page_id", "record_type", "refers_to", "payload_digest", "block")
    segments = rows.where("number is not null").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.where("number is null").select(cols).unionByName(segments.mapInArrow(together, _PAGES))


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_segments: a revisit's length is that of the
    payload it refers to, by digest."""
    known = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    length: Column = F.coalesce("payload_bytes", "full")
    back = found.where("record_type = 'revisit'").drop("payload").join(known, "payload_digest", "left").withColumn("payload_bytes", length)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments"]
    return found.where("record_type = 'response'").select(cols).unionByName(back.select(cols))


def round_trip(pages: DataFrame, **how: int) -> DataFrame:
    """What resolved() finds in the archives of pages, written to a new folder of the shared one."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write(pages, path, **how)
    return resolved(read(spark, path, payloads=False))
