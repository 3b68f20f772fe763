"""Ids of whole texts from the tokenizers library, with each distinct part of a text encoded once per worker.

A text is cut where no token can span the cut; parts met before keep their ids in a bounded memo, which keeps those met
most when it is full. Parts are found, told apart and replaced by their ids as flat arrays over many texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker remembers at most, and between tasks if others need the memory; parts that go to the library at once.
MEMO, WAITING, LEARNT = 1_300_000, 500_000, 1000
_encoders: dict[tuple[str, str], "Encoder"] = {}

GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# First bytes of letters that are white space nowhere: ASCII but for its white space, and U+00C0 to U+07FF.
CLEAR = np.isin(np.arange(256), [*range(128), *range(0xC3, 0xE0)]) & ~GAP
# A stop after a letter begins a part: words with and without one are the same word.
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
STOP = np.isin(np.arange(256), list(b".,;:!?"))


def byte_level(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Where parts begin, and which bytes they keep (all): a space goes with what follows it, a line feed between letters
    stands alone. White space after anything that could itself be white space is not cut off."""
    before = np.zeros(len(codes), dtype=bool)
    before[1:] = CLEAR[codes[:-1]] & (codes[:-1] < 128)
    before[2:] |= (codes[1:-1] >= 128) & (codes[:-2] >= 0xC3) & (codes[:-2] < 0xE0)
    begins = before & GAP[codes]
    lone = begins & (codes == 10)
    begins[1:] |= lone[:-1] & CLEAR[codes[1:]] | LETTER[codes[:-1]] & STOP[codes[1:]]
    return begins, None


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """For vocabularies that drop white space: parts between spaces and line feeds, which go."""
    keep = (codes != 32) & (codes != 10)
    begins = keep.copy()
    begins[1:] &= ~keep[:-1] | LETTER[codes[:-1]] & STOP[codes[1:]]
    return begins, keep


CUTS = {"byte_level": byte_level, "words": words}


class Encoder:
    def __init__(self, path: str, cuts: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = CUTS[cuts]
        # Names of tokens that the library looks for before anything else: a text with one of them is encoded whole.
        self.named = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.widths = None
        if cuts == "byte_level":
            # A letter of a token stands for a byte, so tokens tell the part they belong to.
            vocabulary = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.widths[list(vocabulary.values())] = [len(word) for word in vocabulary]
        # Each known part's number; where its ids begin, how many they are, how often it was met; all ids.
        self.memo: dict[bytes, int] = {}
        self.first, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, "<u4")

    def trim(self, most: int) -> None:
        """Keep so many parts at most: those met most often, and of these the latest."""
        if len(self.memo) <= most:
            return
        kept = np.sort(np.lexsort((-np.arange(len(self.uses)), -self.uses))[:most])
        names = list(self.memo)
        self.memo = {names[at]: number for number, at in enumerate(kept)}
        sizes = self.sizes[kept]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.first[kept] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        self.first, self.sizes, self.uses = ends - sizes, sizes, self.uses[kept]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        texts = texts.cast(pa.large_string())
        named = np.zeros(len(texts), dtype=bool)
        for name in self.named:
            named |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(named), "", pc.fill_null(texts, ""))
        parts, counts = self._parts(plain)
        if len(self.memo) > MEMO:
            self.trim(MEMO * 2 // 3)
        found = parts.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        numbers = np.fromiter((-1 if x is None else x for x in map(self.memo.get, distinct)), np.int64, len(distinct))
        unknown = np.flatnonzero(numbers < 0)
        numbers[unknown] = len(self.memo) + np.arange(len(unknown))
        self._learn([distinct[at] for at in unknown])
        places = found.indices.to_numpy()
        self.uses[numbers] += np.bincount(places, minlength=len(numbers))
        part = numbers[places]
        sizes = self.sizes[part]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.first[part] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        bounds = np.concatenate([[0], ends])[counts].tolist()
        rows = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for at in np.flatnonzero(named):
            rows[at] = np.array(self.tokenizer.encode(texts[at].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return rows

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in a row, and the number of parts before each text."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        codes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        begins, keep = self.cuts(codes)
        # A text begins a part, whatever ends the one before.
        opening = bounds[:-1][np.diff(bounds) > 0]
        begins[opening] = True if keep is None else keep[opening]
        starts = np.flatnonzero(begins)
        counts = np.searchsorted(starts, bounds)
        if keep is not None:
            starts = (np.cumsum(keep) - keep)[starts]
            codes = codes[keep]
        places = np.append(starts, len(codes)).astype(np.int64)
        buffers = [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(codes))]
        return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), counts

    def _learn(self, unknown: list[bytes]) -> None:
        """Parts go to the library as the words of one input."""
        firsts, sizes, ids, known = [self.first], [self.sizes], [self.ids], len(self.ids)
        for start in range(0, len(unknown), LEARNT):
            some = [part.decode() for part in unknown[start : start + LEARNT]]
            if self.widths is None:
                found = self.tokenizer.encode_batch([some], is_pretokenized=True, add_special_tokens=False)[0]
                new = np.array(found.ids, dtype="<u4")
                bounds = np.searchsorted(found.word_ids, np.arange(len(some) + 1))
            else:
                found = self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0]
                new = np.array(found.ids, dtype="<u4")
                ends = np.cumsum([0, *map(len, unknown[start : start + LEARNT])])
                bounds = np.searchsorted(np.cumsum(self.widths[new]), ends, side="right")
            firsts.append(known + bounds[:-1])
            sizes.append(np.diff(bounds))
            ids.append(new)
            known += len(new)
        self.memo.update(zip(unknown, range(len(self.memo), len(self.memo) + len(unknown))))
        self.first, self.sizes, self.ids = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(ids)
        self.uses = np.concatenate([self.uses, np.zeros(len(unknown), np.int64)])


def loaded(path: str, cuts: str) -> Encoder:
    if (path, cuts) not in _encoders:
        _encoders[path, cuts] = Encoder(path, cuts)
    return _encoders[path, cuts]
