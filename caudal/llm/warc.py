"""WARC archives: written with segmented records and chunked transfer coding, read back by segment reassembly.

Writing: each page is one record. Of pages whose payload of at least `LEAST_SHARED` bytes is the same, the one with the
smallest page_id is a `response`, the others are `revisit` records that name it and carry no body. A response longer than
the segment size goes on in `continuation` records. Records are written by Spark's text writer, whose line separator is
the blank line that ends a WARC record, so the files can be in any store that Spark writes to.

Reading: archive files are parsed record by record; segments are grouped by origin, ordered by number, checked against the
total length, and the chunked body is decoded. A record that is damaged or lacks a segment is returned with `problem` set.

Defined results: null html is an empty payload; a null page_id stays null and comes after every number; of repeated rows
(same page_id, same html) one is the response and the others revisit that page_id; a null url is written as the record's
own identifier; an empty table gives no archive rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm.tables import numbered, settled, shared_path

LEAST_SHARED = 100
SEGMENT_BYTES = 8 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2000
END = b"\r\n\r\n"
READ_SCHEMA = "page_id long, origin string, record_type string, refers_to long, number int, total long, digest string, body binary, problem string"


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_of(identifier: str) -> int | None:
    number = identifier.strip("<>").split(":")[2]
    return int(number) if number else None


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cuts of at most `size` bytes, never inside a character; nothing for no data."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        yield data[at:to]
        at = to


def chunked(data: bytes) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in pieces(data, CHUNK_BYTES)) + b"0" + END


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError when the framing is broken or goes on after its end."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("no chunk size")
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            if body[at:] != b"\r\n":
                raise ValueError("something follows the last chunk")
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, identifier: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": "2024-01-01T00:00:00Z", **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def written_url(url: str | None, identifier: str) -> str:
    """Control characters and spaces, which would break the header, are percent-coded."""
    return identifier.strip("<>") if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def records_of(page: dict, segment_bytes: int) -> Iterator[bytes]:
    """page: page_id, row, url, html (null for a revisit), size, digest, first (of a revisit: page_id and row of its response)."""
    own, first = record_id(page["page_id"], page["row"]), page["first"]
    fields = {"WARC-Target-URI": written_url(page["url"], own), "WARC-Payload-Digest": f"sha256:{page['digest']}", "Content-Type": "application/http; msgtype=response"}
    if first is not None:
        fields |= {"WARC-Refers-To": record_id(first["page_id"], first["row"]), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record("revisit", own, fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % page["size"] + END)
        return
    payload = page["html"].encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", own, fields, block)
        return
    cuts = list(pieces(block, segment_bytes))
    yield record("response", own, fields | {"WARC-Segment-Number": "1"}, cuts[0])
    for number, cut in enumerate(cuts[1:], 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if number == len(cuts) else {}
        yield record("continuation", f"{own[:-1]}:{number}>", {"WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(number), **last}, cut)


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """`pages` (page_id, url, html) as .gz archives in the folder `path`, at most RECORDS_PER_FILE records a file."""
    html = F.coalesce("html", F.lit(""))
    whole = settled(numbered(pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"))), "warc-pages")
    shared = (
        whole.where(F.octet_length("html") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.struct("first.page_id", "first.row").alias("first"))
    )
    # Bodies are joined by the row number, which is spread evenly, however many pages share a payload.
    again = whole.select("row", "digest").join(settled(shared, "warc-shared"), "digest").where(F.col("row") != F.col("first.row")).select("row", "first")
    planned = whole.join(again, "row", "left").select("page_id", "row", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("size"), F.lower(F.hex("digest")).alias("digest"), "first")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for x in batch.to_pylist():
                for one in records_of(x, segment_bytes):
                    out.append(one)
                    held += len(one)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    planned.mapInArrow(lay_out, "value string").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive file: fields by lower-case name, and the block."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        to = data.find(END, at)
        if to < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:to].decode().split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = to + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != END:
            raise ValueError(f"the record at byte {at} has another length")
        yield fields, data[start:end]
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`; `body` is the block, or of a revisit its HTTP head."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("origin", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("body", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parsed(content.as_buffer().to_pybytes()):
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    rows.append({
                        "page_id": page_of(origin), "origin": origin, "record_type": f["warc-type"], "body": block, "problem": None,
                        "refers_to": page_of(f["warc-refers-to"]) if "warc-refers-to" in f else None,
                        "number": int(f["warc-segment-number"]) if "warc-segment-number" in f else None,
                        "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        "digest": f.get("warc-payload-digest", "").partition(":")[2] or None,
                    })
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(parse, READ_SCHEMA)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per page record, its segments put together by number. A missing, repeated or short segment is a problem."""
    alone = records.where("number is null").select("page_id", "record_type", "refers_to", "digest", F.array("body").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    parts = records.where("number is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("number") == 1, F.col("digest"))).alias("digest"),
        F.sort_array(F.collect_list(F.struct("number", "body"))).alias("parts"), F.max("total").alias("total"), F.max("number").alias("last"),
    )  # fmt: skip  a group is one page's own segments
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["body"]))
    complete = (F.size("parts") == F.col("last")) & (F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.col("last"))) & (size == F.col("total"))
    whole = parts.select(
        "page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", F.col("parts.body").alias("blocks"),
        F.when(~F.coalesce(complete, F.lit(False)), F.lit("segments do not add up")).alias("problem"),
    )
    return alone.unionByName(whole)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest, problem."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"payload": [], "payload_bytes": [], "payload_digest": [], "problem": []}
            for kind, blocks, digest, problem in zip(*(batch.column(c).to_pylist() for c in ("record_type", "blocks", "digest", "problem")), strict=True):
                head, _, body = b"".join(blocks).partition(END)
                payload, size = None, None
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                if kind == "revisit":
                    size = int(fields[b"content-length"])
                elif problem is None:
                    try:
                        payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        problem = None if found == digest else "payload has another digest"
                        digest = found
                    except ValueError as error:
                        problem = str(error)
                for name, value in zip(out, (payload, size, digest, problem), strict=True):
                    out[name].append(value)
            fixed = [batch.column(c) for c in ("page_id", "record_type", "refers_to")]
            made = [pa.array(out["payload"], pa.binary()), pa.array(out["payload_bytes"], pa.int64()), pa.array(out["payload_digest"], pa.string()), pa.array(out["problem"], pa.string())]
            yield pa.RecordBatch.from_arrays(fixed + made, ["page_id", "record_type", "refers_to", *out])

    return reassembled(read_records(spark, path)).mapInArrow(decode, "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: one row per page without the payload."""
    path = shared_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
