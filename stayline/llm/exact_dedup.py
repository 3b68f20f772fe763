"""Exact copies by an exchange of Golomb-coded fingerprints.

1. Rows. Every row is written once as id, row number, fingerprint and SHA-256 of its text; no text is written.
2. Exchange. Partitions of that narrow table are the senders. Each sorts its distinct fingerprints, cut to so many bits that
   two different texts seldom share them, and sends every owner the slice of its range: the gaps between neighbours,
   Golomb-coded with the power of two that fits their mean. A slice also says which fingerprints the sender met twice.
3. Answers. An owner decodes the slices of its range and returns each a bitmap of the fingerprints that another slice
   holds or that came twice. Fingerprints are spread evenly over owners, and a text that a third of all rows hold is one
   entry for each sender.
4. Suspects. The fingerprints marked in the answers form a sieve of bits, at most ``SIEVE_BITS`` of them whatever the table; the
   texts are read again and only those that pass it are shuffled. Copies within a task meet before the shuffle. With more
   suspects than the sieve can tell apart, texts meet the marked fingerprints in a semi-join instead.
5. Verification. Suspects are grouped by fingerprint and by the bytes of the text itself, so different texts that share a
   fingerprint part here.

Results: a null text equals an empty one; of equal texts the row with the largest doc_id stays, a null id counting as the
smallest, and of repeated rows the first written; an empty table gives an empty result; columns other than doc_id and the
text are left out of ``groups`` and kept by ``distinct_texts``. ``docs`` is read twice and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import pieces_of, written

#: Bits of a cut fingerprint beyond those that count the rows: one row in 2**EXTRA is suspected without reason.
EXTRA = 12
#: Fingerprints that a sender codes at a time, and that an owner holds.
SENT, OWNED = 2_000_000, 1_000_000
SIEVE_BITS = 1 << 24


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


# --- Golomb codes ---


def coded(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct whole numbers from ``low`` on: bits of a remainder, and the codes of the gaps.

    Quotients come first, in unary, then all remainders, each of so many bits.
    """
    gaps = np.diff(values, prepend=np.int64(low))
    mean = max(1.0, float(gaps.mean()))
    width = max(0, int(np.log2(mean * 0.7)) if mean * 0.7 >= 1 else 0)
    ends = np.cumsum((gaps >> width) + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    rests = (gaps[:, None] >> np.arange(width)) & 1
    return width, np.packbits(unary).tobytes(), np.packbits(rests.astype(np.uint8)).tobytes()


def decoded(count: int, low: int, width: int, quotients: bytes, rests: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))
    gaps = np.diff(ends, prepend=-1).astype(np.int64) - 1 << width
    bits = np.unpackbits(np.frombuffer(rests, np.uint8), count=count * width).reshape(count, width)
    return np.cumsum(gaps + bits @ (1 << np.arange(width, dtype=np.int64))) + low


# --- the exchange ---

SLICES = "sender long, owner long, count long, low long, width int, quotients binary, rests binary, twice binary"


def _sender(bits: int, owners: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices of a partition's fingerprints. ``owners`` is a power of two: an owner's range is a prefix of the bits."""
    shift = bits - (owners.bit_length() - 1)

    def slices(some: list[np.ndarray], sender: int) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(some), return_counts=True)
        owner = values >> shift
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(first, [*first[1:], len(values)]):
            low = int(owner[a]) << shift
            width, quotients, rests = coded(values[a:b], low)
            twice = np.packbits(times[a:b] > 1).tobytes()
            rows.append((sender, int(owner[a]), int(b - a), low, width, quotients, rests, twice))
        names = [column.split()[0] for column in SLICES.split(", ")]
        return pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], _schema())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, some, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch["code"].to_numpy())
                size += batch.num_rows
            if size >= SENT:
                yield slices(some, sender)
                sender, some, size = sender + 1, [], 0
        if some:
            yield slices(some, sender)

    return run


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema({name: kinds[kind] for name, kind in (column.split() for column in SLICES.split(", "))})


def _values(row: dict) -> np.ndarray:
    return decoded(row["count"], row["low"], row["width"], row["quotients"], row["rests"])


def _flags(bitmap: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=count).astype(bool)


def _answered(table: pa.Table) -> pa.Table:
    """An owner's answers: for each slice a bitmap of the fingerprints that are elsewhere too."""
    rows = table.to_pylist()
    values = np.concatenate([_values(row) for row in rows])
    twice = np.concatenate([_flags(row["twice"], row["count"]) for row in rows])
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.diff(values[order], prepend=-1))
    sizes = np.diff(np.append(first, len(values)))
    again = np.repeat((sizes > 1) | np.logical_or.reduceat(twice[order], first), sizes)
    marked = np.empty(len(values), dtype=bool)
    marked[order] = again
    ends = np.cumsum([row["count"] for row in rows])[:-1]
    bitmaps = [np.packbits(part).tobytes() for part in np.split(marked, ends)]
    return pa.table(
        {"sender": table["sender"], "owner": table["owner"], "marked": pa.array(bitmaps, pa.binary())}
    )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sender's fingerprints that its answers mark."""
    for batch in batches:
        for row in batch.to_pylist():
            found = _values(row)[_flags(row["marked"], row["count"])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["code"])


def exchanged(codes: DataFrame, bits: int, rows: int) -> DataFrame:
    """The distinct codes, whole numbers below 2**bits, that more than one row holds."""
    owners = 1 << (pieces_of(rows, OWNED) - 1).bit_length()
    slices = written(codes.mapInArrow(_sender(bits, owners), SLICES), "slices")
    answers = slices.groupBy("owner").applyInArrow(_answered, "sender long, owner long, marked binary")
    marked = slices.drop("twice").join(answers, ["sender", "owner"]).mapInArrow(_marked, "code long")
    return written(marked.distinct(), "suspects")


# --- rows, suspects, groups ---


def _with_print(docs: DataFrame, text: str) -> DataFrame:
    content = docs.withColumn("content", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return content.withColumn("print", fingerprint(F.col("content")))


class _Suspects:
    """Divides frames with fingerprints into rows that may have a copy and rows that have none."""

    def __init__(self, prints: DataFrame):
        """``prints``: the written fingerprints of all rows."""
        rows = prints.count()
        # The smallest sufficient number of bits keeps the gaps, and so their codes, short.
        bits = min(62, rows.bit_length() + EXTRA)
        self.code = F.expr(f"shiftrightunsigned(print, {64 - bits})")
        self.codes = exchanged(prints.select(self.code.alias("code")), bits, rows)
        count = self.codes.count()
        self.few = count * 4 <= SIEVE_BITS
        if self.few:
            self.cells = max(1, min(SIEVE_BITS, 1 << (16 * count).bit_length()) // 64)
            self.sieve = self._sieve(prints.sparkSession)

    def _sieve(self, spark: SparkSession) -> Column:
        """16 bits or more for each marked fingerprint, 64 in a cell: one array of at most SIEVE_BITS bits."""
        cell, bit = f"code div 64 % {self.cells}", "CAST(code % 64 AS INT)"
        filled = self.codes.groupBy(F.expr(cell).alias("id")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("word"))
        every = spark.range(self.cells).join(filled, "id", "left")
        ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))))
        return every.agg(F.transform(ordered, lambda item: item["word"]).alias("sieve")).scalar()

    def divided(self, frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that may have a copy; rows that have none."""
        coded_ = frame.withColumn("code", self.code)
        if not self.few:
            inside, outside = (coded_.join(self.codes, "code", kind) for kind in ("left_semi", "left_anti"))
        else:
            word = F.element_at(F.col("sieve"), F.expr(f"CAST(code div 64 % {self.cells} + 1 AS INT)"))
            told = coded_.withColumn("sieve", self.sieve).withColumn("hit", F.getbit(word, F.expr("code % 64")) == 1).drop("sieve")
            inside, outside = told.where("hit").drop("hit"), told.where("NOT hit").drop("hit")
        return inside.drop("code"), outside.drop("code")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    prints = _with_print(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    rows = written(
        prints.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), "print", F.sha2("content", 256).alias("text_sha256")
        ),
        "prints",
    )
    suspects = _Suspects(rows)
    same = (
        suspects.divided(prints)[0]
        .groupBy("print", "content")
        .agg(F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("print", F.sha2("content", 256).alias("text_sha256"), "group_size")
    )
    inside, outside = suspects.divided(rows)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("row"))
    stays = inside.groupBy("print", "text_sha256").agg(F.max(place).alias("stays"))
    found = written(same.join(stays, ["print", "text_sha256"]), "groups")
    alone = {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
    shared = {
        "keep_id": F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("bigint")),
        "kept": F.coalesce(F.col("stays.row") == -F.col("row"), F.lit(True)),
    }

    def shown(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return frame.select("doc_id", *[column.alias(name) for name, column in columns.items()], "text_sha256")

    return shown(outside, alone).union(shown(inside.join(found, ["print", "text_sha256"], "left"), shared))


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    prints = _with_print(docs.select(F.struct("*").alias("document"), F.col(doc_id).alias("id"), F.col(text).alias("text")), "text")
    suspects = _Suspects(written(prints.select("print"), "prints"))
    inside, outside = suspects.divided(prints)
    order = F.struct(F.col("id").isNotNull().alias("known"), "id")
    kept = inside.groupBy("print", "content").agg(F.max_by("document", order).alias("document"))
    return outside.select("document.*").union(kept.select("document.*"))
