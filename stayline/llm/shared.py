"""Helpers that several text operators use: word hashes, window hashes, written tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import scratch

# Fixed value: the multiplier of the polynomial window hash (odd, so that it can be undone modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time, and the longest word that is hashed along with others.
CHUNK = 1 << 20
LONG_WORD = 32
SPACE = np.zeros(256, dtype=bool)
SPACE[list(b"\x20\t\n\x0b\x0c\r")] = True
GAP = re.compile(rb"[\x20\x09-\x0D]")


class Words:
    """64-bit hashes of words: the runs of anything but space and U+0009 to U+000D.

    A word's hash is a polynomial of random numbers, one for each byte value, for many texts at once; that of a long word
    is its own. With ``lower``, A-Z count as a-z.
    """

    def __init__(self, seed: int = 0, lower: bool = False):
        self.seed, self.lower = seed, lower
        letters = [xxhash.xxh3_64_intdigest(bytes([value]), seed=seed) for value in range(256)]
        if lower:
            letters[65:91] = letters[97:123]
        self.letters = np.array(letters, dtype=np.uint64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.repeat(BASE, LONG_WORD - 1)]), dtype=np.uint64)

    def of(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """Hashes of each text's words in order; a null text has none."""
        some: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if some and size + len(text) > CHUNK:
                yield from self._each(some)
                some, size = [], 0
            if len(text) > CHUNK:
                yield np.concatenate([self._hashed(part)[0] for part in _cut(text)])
            else:
                some.append(text)
                size += len(text) + 1
        yield from self._each(some)

    def _each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if texts:
            found, starts = self._hashed(b"\n".join(texts))
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(text) + 1 for text in texts)]))
            for first, last in zip(bounds, bounds[1:]):
                yield found[first:last]

    def _hashed(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        codes = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], ~SPACE[codes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return np.empty(0, np.uint64), starts
        before = np.cumsum(sizes) - sizes
        place = np.arange(before[-1] + sizes[-1]) - np.repeat(before, sizes)
        terms = self.letters[codes[inside[1:-1]]] * self.powers[np.minimum(place, LONG_WORD - 1)]
        found = mixed(np.add.reduceat(terms, before) + sizes.astype(np.uint64))
        for at in np.flatnonzero(sizes > LONG_WORD):
            word = data[starts[at] : starts[at] + sizes[at]]
            found[at] = xxhash.xxh3_64_intdigest(word.lower() if self.lower else word, seed=self.seed)
        return found, starts


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of some CHUNK bytes that end before white space."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def utf8(texts: pa.Array) -> Iterator[bytes | None]:
    return (text.as_py() for text in texts.cast(pa.binary()))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the low-entropy bits of a polynomial hash over all 64 bits."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; empty if there are fewer."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for offset in range(width):
        total = total * BASE + values[offset : offset + count]
    return mixed(total)


def shingles(values: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words, from the words' hashes; fewer words are one run, none no run."""
    if not len(values):
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(values))
    return np.unique(window_hashes(values, width) + np.uint64(width))


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


KEYS = ["known", "id", "tie"]


def document_keys(doc_id: str, tie: str) -> list[Column]:
    """A document's id and the hash of its text as columns without nulls, to group and join by alike."""
    return [F.col(doc_id).isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(tie).alias("tie")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(rows: int, each: int) -> int:
    """Into how many parts that many rows go, at that many rows a part."""
    return max(1, math.ceil(rows / each))


def written(df: DataFrame, name: str) -> DataFrame:
    return scratch.table(df, name)
