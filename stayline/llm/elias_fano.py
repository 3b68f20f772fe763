"""Token ids as a binary file format with Elias-Fano encoded document boundaries.

An archive is a folder of files; a file is a row of segments, each closed by ``TRAILER``. A segment holds the ids of
consecutive documents as one array of 16- or 32-bit integers, and two Elias-Fano sequences: where each document's ids
end, and the document ids (in ascending order, null first). An Elias-Fano sequence keeps the low bits of its values side
by side, the high bits in unary, and the position of every 256th unary one, from which ``select`` finds any value
without a table of 64-bit offsets.

Writing ranges the documents over tasks by id, so a hot source or a long text moves no other document; a segment is
closed at ``SEGMENT_IDS`` ids, so a task holds one segment (or one document, if that is longer). Reading needs one
file in memory; ``FILE_SEGMENTS`` bounds it.

Results: a null text has only its end id; documents without an id come first; repeated ids are all kept, in the order of
their texts' hashes; an empty table gives an archive without segments; other columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import library_tokens
from .shared import partitions

# The marks of the format.
MAGIC = b"EFTOKEN1"
TRAILER = "EFCLOSE\n"
HEADER = struct.Struct("<8sIIQQQqQQQB")
SEGMENT_IDS = 1 << 19
FILE_SEGMENTS = 16
SAMPLED = 256
READ_DOCUMENTS = 1000
READ = "doc_id bigint, part int, start bigint, n_tokens bigint, ids binary"


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, count: int, universe: int, width: int, low: bytes, high: np.ndarray, samples: np.ndarray):
        self.count, self.universe, self.width = count, universe, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        count, universe = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (universe // max(1, count)).bit_length() - 1)
        low = np.zeros((count, width), dtype=np.uint8)
        for bit in range(width):
            low[:, bit] = (values >> np.uint64(bit)) & np.uint64(1)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
        ones = np.zeros(int(places[-1]) + 1 if count else 0, dtype=np.uint8)
        ones[places] = 1
        packed = np.packbits(ones, bitorder="little")
        return cls(
            count, universe, width, np.packbits(low, bitorder="little").tobytes(), packed, places[::SAMPLED].astype("<u4")
        )

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.count, self.universe, self.width)
        return head + self.low + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        count, universe, width = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low = data[at : at + (count * width + 7) // 8]
        at += len(low)
        size = ((universe >> width) + count + 7) // 8 if count else 0
        high = np.frombuffer(data, np.uint8, size, at)
        samples = np.frombuffer(data, "<u4", -(-count // SAMPLED), at + size)
        return cls(count, universe, width, low, high, samples)

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, dtype=np.uint64)
        start = first * self.width
        bits = np.unpackbits(
            np.frombuffer(self.low, np.uint8)[start // 8 : (start + count * self.width + 7) // 8], bitorder="little"
        )
        bits = bits[start % 8 : start % 8 + count * self.width].reshape(count, self.width).astype(np.uint64)
        return (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, at: int) -> int:
        """The value at an index: the nearest sampled one at or before it, then a scan of the unary bits."""
        place = int(self.samples[at // SAMPLED])
        left, byte = at % SAMPLED, place // 8
        word = int(self.high[byte]) >> place % 8 << place % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - at) << self.width | int(self._low(at, 1)[0])

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        high = (places - np.arange(self.count)).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(0, self.count)


def segment(part: int, number: int, start: int, doc_ids: list[int | None], rows: list[bytes]) -> bytes:
    """One closed segment of documents in ascending order; start counts the part's ids before it."""
    lengths = np.array([len(row) // 4 for row in rows], dtype=np.uint64)
    ids = np.frombuffer(b"".join(rows), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    ends = EliasFano.of(np.cumsum(lengths)).to_bytes()
    names = EliasFano.of(np.array([x - base for x in known], dtype=np.uint64)).to_bytes()
    body = ids.astype(f"<u{width}").tobytes()
    nulls = len(doc_ids) - len(known)
    head = HEADER.pack(MAGIC, part, number, start, len(ids), nulls, base, len(ends), len(names), len(body), width)
    return head + ends + names + body


def segments(content: bytes) -> Iterator[tuple[tuple, bytes]]:
    """Header and body of each segment of a file."""
    at = 0
    while at < len(content):
        head = HEADER.unpack_from(content, at)
        size = HEADER.size + sum(head[7:10])
        if head[0] != MAGIC or content[at + size : at + size + len(TRAILER)] != TRAILER.encode():
            raise ValueError("not a whole segment")
        yield head, content[at + HEADER.size : at + size]
        at += size + len(TRAILER)


def documents_of(head: tuple, body: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Document id, start and ids of each document of a segment; its bounds and its name are selected one by one."""
    _, _, _, _, _, nulls, base, ends_size, names_size, _, width = head
    ends = EliasFano.from_bytes(body[:ends_size])
    names = EliasFano.from_bytes(body[ends_size : ends_size + names_size])
    ids = np.frombuffer(body, f"<u{width}", -1, ends_size + names_size)
    end = 0
    for at in range(ends.count):
        start, end = end, ends.select(at)
        yield None if at < nulls else names.select(at - nulls) + base, start, ids[start:end].astype("<u4")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, cuts: str = "words") -> None:
    """Encode every whole text, append the end id, and write the archive in ascending order of doc_id."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_tokens.loaded(tokenizer, cuts)
        end = struct.pack("<I", end_id)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        rows: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            data = segment(part, number, start, names, rows)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                some = batch.slice(first, 1000)
                for name, row in zip(some["doc_id"].to_pylist(), encoder.encode(some["text"])):
                    if rows and size + len(row) // 4 + 1 > SEGMENT_IDS:
                        yield closed()
                        number, start, size = number + 1, start + size, 0
                        names, rows = [], []
                    names.append(name)
                    rows.append(row + end)
                    size += len(row) // 4 + 1
        if rows:
            yield closed()
        encoder.trim(library_tokens.WAITING)

    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    # The text writer passes bytes through as they are and ends each row with the trailer.
    ordered.mapInArrow(packed, "segment binary").selectExpr("cast(segment AS string) AS value").write.option(
        "lineSep", TRAILER
    ).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an archive: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [head for content in batch["content"] for head, _ in segments(content.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([head[1] for head in heads], pa.int32()), pa.array([head[4] for head in heads], pa.int64())],
                ["part", "size"],
            )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            {"doc_id": pa.int64(), "part": pa.int32(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        )
        for batch in batches:
            for content in batch["content"]:
                for head, body in segments(content.as_py()):
                    found = documents_of(head, body)
                    while some := list(islice(found, READ_DOCUMENTS)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name for name, _, _ in some], pa.int64()),
                                pa.array([head[1]] * len(some), pa.int32()),
                                pa.array([start + head[3] for _, start, _ in some], pa.int64()),
                                pa.array([len(ids) for _, _, ids in some], pa.int64()),
                                pa.array([ids.tobytes() for _, _, ids in some], pa.binary()),
                            ],
                            schema=schema,
                        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each writing task: as many as the writer's partitions, whatever the input.
    offsets = (
        files.mapInArrow(totals, "part int, size bigint")
        .groupBy("part")
        .agg(F.sum("size").alias("size"))
        .select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        files.mapInArrow(unpacked, READ)
        .join(F.broadcast(offsets), "part")
        .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
    )
