"""Repeated passages by sparse suffix arrays.

A suffix is retained where the hash of its first ``GRAM`` words is the smallest of a run of such hashes (a minimiser).
Every ``MATCH``-word window has exactly one minimiser, at the same place in each of its copies, so two copies of a window
always meet at a retained suffix. Suffixes are sorted by a hash of those words and a hash of the text around them that
their windows cover, and each is compared with its neighbours by these hashes:

* a suffix whose neighbour has the same text around it repeats with all its windows;
* otherwise 128-bit fingerprints of all windows around the suffix are grouped over the whole table, and those found twice
  repeat. No match is extended word by word: that would need both texts where two suffixes meet. Copies with the same text
  around them send their windows once.

Sorting ranges over all columns, so a frequent passage is spread over tasks; what a task cannot see beyond the edges of
its range it hands to the second step. Windows are counted before they are shuffled. Documents are told apart by id and
128 bits of their text, and windows by 128 bits.

Results: a window found twice or more in the table (also twice in one document) is repeated; its first place in order of
doc_id (null first), hash and position is kept, and ``cleaned`` takes the words out that later ones cover and no kept
window does. Texts of fewer than ``MATCH`` words, empty and null ones repeat nothing and stay as they are. Rows with the
same id and text count as one document, and both stay. Existing columns of the outputs' names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import BASE, KEYS, Words, document_keys, mixed, partitions, pieces_of, signed, utf8, window_hashes, written

MATCH = 50
GRAM = 20
SORTED_ROWS = 1_000_000
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SUFFIX = "gram long, around long, doc_id long, tie binary, first int, n int"
_words = [Words(seed) for seed in (0, 1)]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, count: int) -> np.ndarray:
    """Powers 0 to count - 1 of the base or its inverse, modulo 2**64."""
    if len(_powers[kind]) < count:
        steps = np.full(2 * count, BASE if kind == "up" else INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:count]


class Ranges:
    """Hashes of any range of a list of words."""

    def __init__(self, values: np.ndarray):
        sums = np.cumsum(values * _power("up", len(values)), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.down = _power("down", len(values) + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def suffixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Retained suffixes: hash of their first words, hash of the text their windows cover, first window, windows."""
    count = len(values) - MATCH + 1
    if count <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = window_hashes(values, GRAM)
    owner = np.lib.stride_tricks.sliding_window_view(grams, MATCH - GRAM + 1).argmin(axis=1) + np.arange(count)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:], [count]])
    around = Ranges(values).of(first, last - 1 + MATCH)
    return signed(grams[owner[first]]), signed(around), first, last - first


def _tie(text: str = "text") -> Column:
    """128 bits of a text, which tell documents of one id, or of none, apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            some = batch.slice(start, 1000)
            parts = [suffixes(values) for values in _words[0].of(utf8(some["text"]))]
            own = pa.array(np.repeat(np.arange(len(parts)), [len(part[0]) for part in parts]))
            gram, around, first, n = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram), pa.array(around), some["doc_id"].take(own), some["tie"].take(own),
                    pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
                ],
                ["gram", "around", "doc_id", "tie", "first", "n"],
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a sorted range. many: another suffix has the same text around it; head: the first such one of the
    range; open: the windows have to be looked at; source: the head's place."""
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    gram, around = table["gram"].to_numpy(), table["around"].to_numpy()
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    head = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
    group, run = np.cumsum(new_gram) - 1, np.cumsum(head) - 1
    in_group, in_run, runs = np.bincount(group), np.bincount(run), np.bincount(group[head])
    edge = np.zeros(len(in_group), bool)
    edge[[0, -1]] = True
    kept = (in_group[group] > 1) | edge[group]
    many = in_run[run] > 1
    opened = head & ((runs[group] > 1) | edge[group])
    heads = np.flatnonzero(head)[run]
    source = table.select(["doc_id", "tie", "first"]).take(pa.array(heads))
    chosen = pa.array(np.flatnonzero(kept))
    found = pa.table(
        [
            table["doc_id"], table["tie"], table["first"], table["n"],
            pa.array(many), pa.array(head), pa.array(opened), *source.columns,
        ],
        ["doc_id", "tie", "first", "n", "many", "head", "open", "source", "source_tie", "source_first"],
    ).take(chosen)
    yield from found.combine_chunks().to_batches(max_chunksize=50_000)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of each document's open suffixes. leads: the first window of a head that has copies."""
    for batch in batches:
        for row in (row for at in range(0, batch.num_rows, 200) for row in batch.slice(at, 200).to_pylist()):
            text = row["text"].encode("utf-8", "surrogatepass")
            first = np.array([x["first"] for x in row["open"]])
            n = np.array([x["n"] for x in row["open"]])
            many = np.repeat(np.array([x["many"] for x in row["open"]]), n)
            start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            leads = many & (start == np.repeat(first, n))
            one, two = (signed(Ranges(next(words.of([text]))).of(start, start + MATCH)) for words in _words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one), pa.array(two), pa.array([row["doc_id"]] * len(start), pa.int64()),
                    pa.array([row["tie"]] * len(start), pa.binary()), pa.array(start.astype(np.int32)), pa.array(many),
                    pa.array(leads),
                ],
                ["one", "two", "doc_id", "tie", "first", "many", "leads"],
            )


def repeated(docs: DataFrame) -> DataFrame:
    """Repeated pieces of each document: doc_id, tie, first word, n windows, kept (the first place), source (the
    doc_id of the first window's first place)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _tie().alias("tie"), "text")
    table = written(texts.mapInArrow(_suffix_rows, SUFFIX), "suffixes")
    ranges = max(partitions(spark), pieces_of(table.count(), SORTED_ROWS))
    order = ["gram", "around", "doc_id", "tie", "first"]
    compared = written(
        table.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _compared,
            "doc_id long, tie binary, first int, n int, many boolean, head boolean, open boolean, source long, source_tie binary, "
            "source_first int",
        ),
        "compared",
    )
    whole = compared.where("NOT open AND many")
    keys = document_keys("doc_id", "tie")
    opened = (
        compared.where("open")
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("first", "n", "many")).alias("open"))
    )
    # One row of each document is enough. Grouped by the join's keys, so that texts are shuffled once.
    single = texts.groupBy(*keys).agg(F.first("text").alias("text"))
    windows = written(
        single.join(opened, KEYS)
        .select(F.expr("IF(known, id, NULL)").alias("doc_id"), "tie", "text", "open")
        .mapInArrow(_window_rows, "one long, two long, doc_id long, tie binary, first int, many boolean, leads boolean"),
        "windows",
    )
    place = F.struct("doc_id", "tie", "first")
    twice = (
        windows.groupBy("one", "two")
        .agg(F.sum(F.expr("IF(many, 2, 1)")).alias("times"), F.min(place).alias("earliest"))
        .where("times > 1")
    )
    single_windows = windows.join(twice, ["one", "two"]).select(
        "doc_id",
        "tie",
        "first",
        F.lit(1).alias("n"),
        place.eqNullSafe(F.col("earliest")).alias("kept"),
        F.col("earliest.doc_id").alias("source"),
    )
    # An open head's windows may occur earlier, beyond its range or with another text around them: its copies, which sent
    # none, follow it to that place. Heads that are the first place themselves need no row.
    moved = (
        windows.where("leads")
        .join(twice, ["one", "two"])
        .where(~place.eqNullSafe(F.col("earliest")))
        .select(
            *document_keys("doc_id", "tie"), F.col("first").alias("at"), F.struct("earliest.doc_id").alias("earlier")
        )
    )
    whole = (
        whole.select(
            "doc_id", F.col("tie").alias("own_tie"), "first", "n", "head", "source",
            *document_keys("source", "source_tie"), F.col("source_first").alias("at"),
        )
        .join(moved, [*KEYS, "at"], "left")
        .select(
            "doc_id",
            F.col("own_tie").alias("tie"),
            "first",
            "n",
            F.col("head").alias("kept"),
            F.expr("IF(earlier IS NULL, source, earlier.doc_id)").alias("source"),
        )
    )
    return whole.unionByName(single_windows)


def merged(first: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words (from, to) that runs of windows cover."""
    order = np.argsort(first, kind="stable")
    spans: list[tuple[int, int]] = []
    for a, b in zip(first[order].tolist(), (first + n - 1 + MATCH)[order].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        {
            "doc_id": pa.int64(), "tie": pa.binary(), "span": pa.int32(), "first_word": pa.int32(), "end_word": pa.int32(),
            "removed_words": pa.int32(), "source_id": pa.int64(), "removed": pa.list_(pa.int32()),
        }
    )
    for batch in batches:
        rows = []
        parts = batch["parts"]
        bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
        flat = parts.flatten()
        firsts, counts = flat.field("first").to_numpy(), flat.field("n").to_numpy()
        keeps, sources = flat.field("kept").to_numpy(zero_copy_only=False), flat.field("source")
        for name, tie, low, high in zip(batch["doc_id"].to_pylist(), batch["tie"].to_pylist(), bounds, bounds[1:]):
            first, n, kept = firsts[low:high], counts[low:high], keeps[low:high]
            spans = merged(first, n)
            gone = np.zeros(spans[-1][1], dtype=bool)
            for a, b in merged(first[~kept], n[~kept]):
                gone[a:b] = True
            for a, b in merged(first[kept], n[kept]):
                gone[a:b] = False
            places = {int(at): low + i for i, at in reversed(list(enumerate(first)))}
            for number, (a, b) in enumerate(spans):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))) + a
                rows.append(
                    {
                        "doc_id": name, "tie": tie, "span": number, "first_word": a, "end_word": b,
                        "removed_words": int(gone[a:b].sum()), "source_id": sources[places[a]].as_py(), "removed": edges.tolist(),
                    }
                )
        yield pa.RecordBatch.from_pylist(rows, schema)


def spans(docs: DataFrame) -> DataFrame:
    """Repeated passages: doc_id, tie, span, first_word, end_word, removed_words, source_id (the document that keeps the
    passage's start), removed (bounds of the word ranges that go)."""
    parts = F.collect_list(F.struct("first", "n", "kept", "source")).alias("parts")
    return (
        repeated(docs)
        .groupBy("doc_id", "tie")
        .agg(parts)
        .mapInArrow(
            _spans,
            "doc_id long, tie binary, span int, first_word int, end_word int, removed_words int, source_id long, removed array<int>",
        )
    )


def without(text: str, removed: list[int]) -> str:
    """A text without ranges of its words and the white space before each of them."""
    places = [match.span() for match in WORD.finditer(text)]
    parts, at = [], 0
    for first, end in sorted(zip(removed[::2], removed[1::2])):
        parts.append(text[at : places[first - 1][1] if first else 0])
        at = places[end - 1][1]
    return "".join([*parts, text[at:]])


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents without the passages that an earlier place keeps."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, removed: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), removed.to_pylist())
        return pa.array([without(text, bounds) if text and bounds else text for text, bounds in rows], pa.string())

    gone = spans(docs).groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("removed")).alias("removed"))
    gone = gone.where("size(removed) > 0")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("g.doc_id")) & (_tie("d.text") == F.col("g.tie"))
    joined = (
        docs.alias("d")
        .join(gone.alias("g"), same, "left")
        .select(F.struct("d.*").alias("document"), F.col("d.text").alias("text"), F.col("g.removed").alias("removed"))
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut("text", "removed"))
    kept = {name: F.col("document.`" + name.replace("`", "``") + "`") for name in docs.columns}
    return joined.withColumn("text", text).select(
        *[(F.col("text") if name == "text" else column).alias(name) for name, column in kept.items()]
    )
