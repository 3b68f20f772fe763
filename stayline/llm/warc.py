"""WARC archives of pages: chunked transfer framing, record segmentation, revisits; and their reassembly.

Writing gives every page a response record, or a revisit record where another page has the same payload and the larger
page id. A block beyond ``SEGMENT`` bytes goes on in continuation records that name the first one as origin, carry a
segment number and, in the last, the total length. Files roll after ``FILE_RECORDS`` records, so that reading holds one
bounded file; a page's segments may stand in different files.

Reading parses each file, groups the records of segmented blocks by origin, orders them by segment number, checks the
total length, and decodes the chunked framing. Only segmented blocks are shuffled.

Results: a null html is an empty payload; a null url leaves the target field out; pages without an id are written and
come back without one; pages with the same id and payload are all responses; a block whose segments do not add up, or
whose payload does not match its digest, comes back with whole = false; an empty table gives no records; other columns
are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
FILE_RECORDS = 2048
# What the format prescribes.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = (
    "record_id string, kind string, origin string, number int, total bigint, page_id bigint, target_uri string, "
    "payload_digest string, refers_to bigint, block binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[at : at + CHUNK] for at in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. ValueError if it is cut short."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[line + 2 : at])
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, by its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [line.split(b":", 1) for line in head.lower().split(b"\r\n")[1:]]
    coded = any(name.strip() == b"transfer-encoding" and value.strip() == b"chunked" for name, value in fields)
    return dechunked(body) if coded else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the line feeds that close it."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def records_of(page_id, url, payload: bytes, refers: bool, refers_to, date: str) -> Iterator[bytes]:
    """The records of one page."""
    name = uuid.uuid4().urn
    common = [
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else None),
        ("WARC-Page-ID", page_id),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers:
        own = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To-Page-ID", refers_to)]
        yield record(own + common, HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield record([("WARC-Type", "response"), *common], block)
        return
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], block[:SEGMENT])
    for number, at in enumerate(range(SEGMENT, len(block), SEGMENT), 2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
            ("WARC-Date", date),
            ("WARC-Segment-Origin-ID", f"<{name}>"),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if at + SEGMENT >= len(block) else None),
        ]
        yield record(fields, block[at : at + SEGMENT])


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a file, which may be gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        start = data.index(END.encode(), at)
        version, *lines = data[at:start].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {name.lower(): value.strip() for name, value in (line.split(":", 1) for line in lines)}
        end = start + 4 + int(fields["content-length"])
        if data[end : end + 4] != END.encode():
            raise ValueError("a record is cut short")
        yield fields, data[start + 4 : end]
        at = end + 4


def write(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", compress: bool = True) -> None:
    """Write page_id, url, html as archives. Payloads under ``least`` bytes are never revisits."""
    full = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    largest = (
        full.where(F.length("payload") >= least)
        .groupBy("same")
        .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    refers = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows = full.join(largest, "same", "left").select("page_id", "url", "payload", refers.alias("refers"), "largest")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200).to_pylist()
                made = [
                    made
                    for row in some
                    for made in records_of(row["page_id"], row["url"], row["payload"], row["refers"], row["largest"], date)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    # The text writer passes bytes through as they are and closes each record with the two line feeds.
    rows.mapInArrow(records, "record binary").selectExpr("cast(record AS string) AS value").write.option(
        "lineSep", END
    ).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip" if compress else "none").text(path)


def _records(segmented: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            {
                "record_id": pa.string(),
                "kind": pa.string(),
                "origin": pa.string(),
                "number": pa.int32(),
                "total": pa.int64(),
                "page_id": pa.int64(),
                "target_uri": pa.string(),
                "payload_digest": pa.string(),
                "refers_to": pa.int64(),
                "block": pa.binary(),
            }
        )

        def whole(fields: dict[str, str], name: str) -> int | None:
            return int(fields[name]) if name in fields else None

        for batch in batches:
            for content in batch["content"]:
                rows = []
                for fields, block in parsed(content.as_py()):
                    if ("warc-segment-number" in fields) != segmented:
                        continue
                    rows.append(
                        {
                            "record_id": fields.get("warc-record-id"),
                            "kind": fields["warc-type"],
                            "origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")),
                            "number": whole(fields, "warc-segment-number"),
                            "total": whole(fields, "warc-segment-total-length"),
                            "page_id": whole(fields, "warc-page-id"),
                            "target_uri": fields.get("warc-target-uri"),
                            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "refers_to": whole(fields, "warc-refers-to-page-id"),
                            "block": block,
                        }
                    )
                for first in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[first : first + 500], schema)

    return run


def _payload(blocks: pa.Array, sizes: pa.Array, kinds: pa.Array, digests: pa.Array) -> pa.Array:
    rows = []
    for block, size, kind, expected in zip(blocks, sizes.to_pylist(), kinds.to_pylist(), digests.to_pylist()):
        data = b"".join(block.as_py())
        if kind == "revisit":
            rows.append({"payload": None, "whole": True})
            continue
        try:
            payload = payload_of(data)
            rows.append({"payload": payload, "whole": size == len(data) and expected in (None, digest(payload))})
        except ValueError:
            rows.append({"payload": None, "whole": False})
    return pa.array(rows, pa.struct({"payload": pa.binary(), "whole": pa.bool_()}))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pages of archives: page_id, target_uri, record_type, refers_to, payload_digest, payload (null in revisits), whole."""
    decoded = F.arrow_udf(_payload, "struct<payload:binary,whole:boolean>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    single = files.mapInArrow(_records(False), RECORD).select(
        "page_id", "target_uri", "kind", "refers_to", "payload_digest",
        F.array("block").alias("blocks"), F.length("block").cast("bigint").alias("size"),
    )
    parts = F.sort_array(F.collect_list(F.struct("number", "total", "block", "page_id", "target_uri", "kind", "payload_digest")))
    joined = (
        files.mapInArrow(_records(True), RECORD)
        .groupBy("origin")
        .agg(parts.alias("parts"))
        .select(
            F.expr("parts[0].page_id").alias("page_id"),
            F.expr("parts[0].target_uri").alias("target_uri"),
            F.expr("parts[0].kind").alias("kind"),
            F.lit(None).cast("bigint").alias("refers_to"),
            F.expr("parts[0].payload_digest").alias("payload_digest"),
            F.col("parts.block").alias("blocks"),
            # The last segment carries the total; numbers must run from 1 without a gap.
            F.expr("IF(element_at(parts, -1).number = size(parts), element_at(parts, -1).total, NULL)").alias("size"),
        )
    )
    return (
        single.unionByName(joined)
        .withColumn("body", decoded("blocks", "size", "kind", "payload_digest"))
        .select("page_id", "target_uri", F.col("kind").alias("record_type"), "refers_to", "payload_digest", "body.payload", "body.whole")
    )
