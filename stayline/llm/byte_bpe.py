"""Byte-level BPE encoding and decoding by replaying merges over a corpus.

Documents are cut into parts, some ``TEXT`` bytes at a time. The distinct pre-tokens of parts not met before, some ``CORPUS`` bytes
of them, form one corpus of byte tokens. An inverted index leads from the rank of each mergeable pair to the positions where it stands.
Ranks are taken in rising order; a merge touches only its two neighbours, whose new pairs enter the index. A part met before
keeps its ids (in a bounded memo, which keeps those met most when it is full). Results leave a worker as they are made, so
that a batch of long texts is never held in more than one form.

A merge can only make pairs of higher rank when the ranks come from training. Where a vocabulary breaks that, the words
concerned are encoded one by one, lowest rank first, so that ids are always those of the per-word rule.

Results: a null or empty text gives no ids and no bytes; rows are treated alone, so repeated rows and ties need no rule;
an existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .library_tokens import Encoder, byte_level

#: Parts, their ids in all, and ranks of pairs that a worker remembers at most when it goes on to more text.
MEMO, IDS, PAIRS = 300_000, 4_000_000, 300_000
#: Bytes of text cut at a time, and of words that are one corpus.
TEXT, CORPUS = 1 << 19, 1 << 17
#: Ids decoded at a time.
DECODED = 1 << 16

_replays: dict[tuple[str, str], "Replay"] = {}


class Replay(Encoder):
    """Encoder and decoder of one rank file; parts that the memo doesn't have are encoded by replaying merges.

    No match of the pattern spans two of the parts that ``byte_level`` cuts, nor does its lookahead reach beyond one.
    """

    def __init__(self, path: str, pattern: str):
        self.cuts, self.named = byte_level, []
        self.memo: dict[bytes, int] = {}
        self.first, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([value])] for value in range(256)]
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, int] = {}
        self.singles = np.array(self.single)
        self.first_ranks = np.array(
            [[self.ranks.get(bytes([left, right]), -1) for right in range(256)] for left in range(256)]
        )
        # Bytes of all tokens in a row, and where each token's begin.
        sizes = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        sizes[list(self.bytes_of)] = [len(token) for token in self.bytes_of.values()]
        self.token_sizes, self.token_starts = sizes, np.cumsum(sizes) - sizes
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of[rank] for rank in sorted(self.bytes_of)), np.uint8)

    def rank_of(self, left: int, right: int) -> int:
        """Rank of the token that a pair merges into, -1 if it doesn't merge."""
        key = left << 32 | right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return rank

    def one_word(self, word: bytes) -> list[int]:
        ids = [self.single[value] for value in word]
        while len(ids) > 1:
            ranks = [self.rank_of(*pair) for pair in zip(ids, ids[1:])]
            found = [rank for rank in ranks if rank >= 0]
            if not found:
                break
            at = ranks.index(min(found))
            ids[at : at + 2] = [ranks[at]]
        return ids

    def replay(self, corpus: list[bytes]) -> list[list[int]]:
        """Ids of every word of the corpus."""
        ids, sizes = self.merged(corpus)
        return [row.tolist() for row in np.split(ids, np.cumsum(sizes)[:-1])] if corpus else []

    def merged(self, corpus: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of the corpus in a row, and the number of each word's."""
        data = np.frombuffer(b"".join(corpus), np.uint8)
        sizes = np.array([len(word) for word in corpus], dtype=np.int64)
        bounds = np.cumsum(sizes)
        starts = (bounds - sizes).tolist()
        size = len(data)
        token = self.singles[data].tolist()
        inner = np.ones(size, dtype=bool)  # positions with a neighbour to the right
        inner[bounds[sizes > 0] - 1] = False
        after = np.where(inner, np.arange(1, size + 1), -1).tolist()
        before = np.where(np.concatenate([[False], inner[:-1]]), np.arange(-1, size - 1), -1).tolist() if size else []
        first = self.first_ranks[data[:-1], data[1:]] if size else np.empty(0, np.int64)
        places = np.flatnonzero(inner[:-1] & (first >= 0))
        places = places[np.argsort(first[places], kind="stable")]
        wanted = np.full(size, -1)  # rank of the pair that now begins at a position
        wanted[places] = first[places]
        wanted = wanted.tolist()
        ranks, cuts = np.unique(first[places], return_index=True)
        index: dict[int, list[int]] = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(places, cuts[1:]))))
        ranks = list(index)
        heapify(ranks)
        irregular: set[int] = set()
        known, rank_of, entries_of = self.pairs.get, self.rank_of, index.get
        while ranks:
            rank = heappop(ranks)
            some = index.pop(rank, ())
            for at in sorted(some) if len(some) > 1 else some:
                if wanted[at] != rank:
                    continue
                following = after[at]
                token[at], token[following], wanted[following] = rank, -1, -1
                beyond, ahead = after[following], before[at]
                after[at] = beyond
                if beyond >= 0:
                    before[beyond] = at
                    right = token[beyond]
                    wanted[at] = new = known(rank << 32 | right) or rank_of(rank, right)
                    if new >= 0:
                        if new <= rank:
                            irregular.add(bisect_right(starts, at) - 1)
                        if (entries := entries_of(new)) is not None:
                            entries.append(at)
                        else:
                            index[new] = [at]
                            heappush(ranks, new)
                else:
                    wanted[at] = -1
                if ahead >= 0:
                    left = token[ahead]
                    wanted[ahead] = new = known(left << 32 | rank) or rank_of(left, rank)
                    if new >= 0:
                        if new <= rank:
                            irregular.add(bisect_right(starts, at) - 1)
                        if (entries := entries_of(new)) is not None:
                            entries.append(ahead)
                        else:
                            index[new] = [ahead]
                            heappush(ranks, new)
        ids = np.array(token, dtype=np.int64)
        for at in irregular:
            word = self.one_word(corpus[at])
            ids[starts[at] : bounds[at]] = word + [-1] * (len(corpus[at]) - len(word))
        kept = np.concatenate([[0], np.cumsum(ids >= 0)])
        return ids[ids >= 0], kept[bounds] - kept[bounds - sizes]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        if len(self.memo) > MEMO or len(self.ids) > IDS:
            self.trim(MEMO * 2 // 3)
            if len(self.ids) > IDS:
                self.trim(0)
        return super().encode(texts)

    def encode_batch(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Arrays of the ids of each text, for some TEXT bytes at a time."""
        for start, end in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), TEXT):
            rows = self.encode(texts[start:end])
            offsets = np.cumsum([0, *(len(row) // 4 for row in rows)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))

    def _learn(self, unknown: list[bytes]) -> None:
        """Ids of the parts' words, the words of CORPUS bytes at a time."""
        firsts, sizes, ids, known = [self.first], [self.sizes], [self.ids], len(self.ids)
        for start, end in _slices(np.array([len(part) for part in unknown], np.int64), CORPUS) if unknown else ():
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            split = [self.pattern.findall(part.decode()) for part in unknown[start:end]]
            numbers: dict[str, int] = {}
            words = np.array([numbers.setdefault(word, len(numbers)) for row in split for word in row], np.int64)
            found, size = self.merged([word.encode() for word in numbers])
            first = (np.cumsum(size) - size)[words]
            size = size[words]
            ends = np.cumsum(size)
            ids.append(found[np.repeat(first - (ends - size), size) + np.arange(size.sum())].astype("<u4"))
            ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
            firsts.append(known + ends[:-1])
            sizes.append(np.diff(ends))
            known += len(ids[-1])
        self.memo.update(zip(unknown, range(len(self.memo), len(self.memo) + len(unknown))))
        self.first, self.sizes, self.ids = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(ids)
        self.uses = np.concatenate([self.uses, np.zeros(len(unknown), np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        sizes = self.token_sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.token_bytes[np.repeat(self.token_starts[ids] - before, sizes) + np.arange(sizes.sum())].tobytes()

    def decode_batch(self, ids: pa.Array) -> Iterator[pa.Array]:
        """The bytes of each row of ids (none for null), for some DECODED ids at a time."""
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        for start, end in _slices(lengths, DECODED):
            some = ids[start:end].flatten().to_numpy()
            parts = [some[at : at + DECODED] for at in range(0, len(some), DECODED)]
            data = b"".join(map(self.decode, parts))
            before = np.cumsum(np.concatenate([[0], *(self.token_sizes[part] for part in parts)]), dtype=np.int64)
            offsets = before[np.cumsum([0, *lengths[start:end]])]
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
            yield pa.Array.from_buffers(pa.large_binary(), end - start, buffers).cast(pa.binary())


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items of some ``most`` in all; an item that is larger is alone. At least one run, if an empty one."""
    ends = np.cumsum(sizes)
    start = 0
    while True:
        before = ends[start - 1] if start else 0
        end = min(len(ends), max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield start, end
        if end >= len(ends):
            return
        start = end


def loaded(path: str, pattern: str) -> Replay:
    """One encoder for each rank file and Python worker."""
    if (path, pattern) not in _replays:
        _replays[path, pattern] = Replay(path, pattern)
    return _replays[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the ids of each whole text, without special tokens, as an array of int."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        replay = loaded(path, pattern)
        for batch in batches:
            yield from replay.encode_batch(batch)

    return df.withColumn(into, ids_of(_column(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that each array of ids stands for."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        replay = loaded(path, pattern)
        for batch in batches:
            yield from replay.decode_batch(batch)

    return df.withColumn(into, bytes_of(_column(ids)))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
