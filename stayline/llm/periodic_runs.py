"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q that is at least ``LEAST`` words and ``TIMES`` periods long and that no
neighbouring word extends. Each of its words stands ``TIMES`` times or more inside it. So a word that occurs more rarely
within a segment is in no run of that segment and splits it; the parts are counted anew until nothing splits. Prose falls
apart in a few turns.

What survives is scanned at lags: words q apart are compared over the whole segment, and long enough stretches of equal
pairs are the runs. Lags below ``CLOSE`` are all tried. For longer ones, a run of period q in [s, 2s) repeats each window
of s words q words on. Windows start at every s/2 words; those of the run whose repeat lies inside it cover q + s/4 words or
more and overlap by half, so one of them has no period of s/4 or less (else the run had a period below q). That one occurs
at most a handful of times that near, and those distances are the lags; windows that occur more often are left to such
neighbours. Hashes only propose lags: the words themselves decide.

Results: null and empty texts have no word and no run; a row without an id is taken as it is written; repeated rows give
equal rows; an empty table gives an empty result; columns other than doc_id and text are left out. A text is scanned whole
by one task, in memory proportional to its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import BASE, utf8

LEAST = 24
TIMES = 3
CLOSE = 16
#: A window without a period of a quarter of its length occurs at most so often in the next two lengths.
NEAR = 8

Run = tuple[int, int, int]  # start, length, period
Rewritten = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as a number, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, len(words))


def segments(words: np.ndarray) -> list[tuple[int, int]]:
    """First and end place of the stretches that splitting at rare words leaves."""
    place = np.arange(len(words))
    part = np.zeros(len(words), dtype=np.int64)
    while len(place):
        _, of, times = np.unique(part * (int(words.max()) + 1) + words[place], return_inverse=True, return_counts=True)
        often = times[of] >= TIMES
        place, part = place[often], part[often]
        if not len(place):
            break
        opens = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(part) > 0)])
        part = np.cumsum(opens) - 1
        long = np.bincount(part)[part] >= LEAST
        place, part = place[long], part[long]
        if often.all() and long.all():
            first = np.flatnonzero(opens)
            return [(int(a), int(b) + 1) for a, b in zip(place[first], place[np.append(first[1:], len(place)) - 1])]
    return []


def lags(words: np.ndarray) -> list[int]:
    """Periods that runs of these words may have."""
    longest = len(words) // TIMES
    found = set(range(1, min(CLOSE - 1, longest) + 1))
    hashes = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    # Hash of the words from each place on, over a width that doubles.
    size, power = 1, int(BASE)
    while 2 * size <= longest and len(hashes) > size:
        hashes = hashes[: len(hashes) - size] * np.uint64(power) + hashes[size:]
        size, power = 2 * size, power * power % (1 << 64)
        if size >= CLOSE:
            found.update(_distances(hashes, size))
    return sorted(q for q in found if q <= longest)


def _distances(hashes: np.ndarray, size: int) -> set[int]:
    """Distances from size to twice the size at which the windows at every half size occur again, if they are few."""
    _, rank = np.unique(hashes, return_inverse=True)
    count = len(rank)
    keys = np.sort(rank * (2 * count) + np.arange(count))
    starts = np.arange(0, count, size // 2)
    own = rank[starts] * (2 * count)
    first = np.searchsorted(keys, own + np.minimum(starts + size, 2 * count - 1))
    last = np.searchsorted(keys, own + np.minimum(starts + 2 * size, 2 * count - 1))
    found: set[int] = set()
    few = last - first <= NEAR
    for at in range(NEAR):
        here = few & (first + at < last)
        found.update((keys[first[here] + at] - own[here] - starts[here]).tolist())
    return found


def _divisors(period: int) -> Iterator[int]:
    """The period divided by each of its primes: a stretch of three periods that has a shorter one has one of these."""
    left, prime = period, 2
    while left > 1:
        if prime * prime > left:
            prime = left
        if left % prime == 0:
            yield period // prime
            while left % prime == 0:
                left //= prime
        prime += 1


def scanned(words: np.ndarray) -> Iterator[Run]:
    """Runs of one segment, by lag."""
    for period in lags(words):
        equal = np.concatenate([[False], words[period:] == words[:-period], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        sizes = edges[1::2] - edges[::2] + period
        for at in np.flatnonzero(sizes >= max(LEAST, TIMES * period)):
            start, size = int(edges[2 * at]), int(sizes[at])
            stretch = words[start : start + size]
            if not any(np.array_equal(stretch[less:], stretch[:-less]) for less in _divisors(period)):
                yield start, size, period


def runs(words: np.ndarray) -> list[Run]:
    """All runs, by start and period."""
    return sorted((start + at, size, period) for at, end in segments(words) for start, size, period in scanned(words[at:end]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, size, period in found:
        keep[start + period : start + size] = False
    return [words[at] for at in np.flatnonzero(keep)]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, chosen by its id, made to repeat from some place on."""
    if doc_id is None or not words:
        return words
    drawn = zlib.crc32(str(doc_id).encode())
    rest = drawn // 10
    if drawn % 10:
        return words
    start = rest % len(words)
    period = 1 + (len(words) - start) // (3 + rest % 8)
    return words[:start] + [words[start + at % period] for at in range(len(words) - start)]


SCHEMA = pa.schema(
    {"doc_id": pa.int64()}
    | dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], pa.int64())
    | {"starts": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "periods": pa.list_(pa.int64()), "collapsed": pa.string()}
)


def _of(rewritten: Rewritten | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"])):
                words = (text or b"").split()
                if rewritten:
                    words = rewritten(doc_id, words)
                found = runs(numbered(words)) if len(words) >= LEAST else []
                # Compared as fractions, without rounding.
                best = found[0] if found else (None, None, None)
                for one in found:
                    if one[1] * best[2] > best[1] * one[2]:
                        best = one
                starts, lengths, periods = zip(*found) if found else ((), (), ())
                rows.append(
                    dict(
                        doc_id=doc_id, n_runs=len(found), start=best[0], length=best[1], period=best[2],
                        exponent_milli=1000 * best[1] // best[2] if found else None,
                        starts=starts, lengths=lengths, periods=periods, collapsed=b" ".join(collapsed(words, found)).decode(),
                    )
                )
                size += len(text or b"")
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


def periodic_runs(docs: DataFrame, rewritten: Rewritten | None = None) -> DataFrame:
    """Per document: n_runs; start, length, period and exponent_milli of the run with most periods (null without runs);
    all runs as the arrays starts, lengths, periods; and the text with every run collapsed to one period, its words joined
    by a space. ``rewritten`` changes a document's words first."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = ", ".join(f"{name} long" for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli"))
    lists = ", ".join(f"{name} array<long>" for name in ("starts", "lengths", "periods"))
    return texts.mapInArrow(_of(rewritten), f"{numbers}, {lists}, collapsed string")
