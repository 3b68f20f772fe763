"""Phrase collocations, counted by weighted acyclic automata.

Words are told apart by 64-bit labels; all words of the table are compared, and another seed is taken if two share one.
Phrases of one, of two, and of three and four words are counted in three steps alike:

1. Shards. A task numbers the words of its texts, sorts the phrases of a shard and builds a count transducer from them
   (``phrase_machines``) for every language and prefix range: a hash of the first word, from three words on of the first
   three. So a phrase that a third of all rows hold is one path of a shard's machine, and the continuations of a prefix,
   which share its range, are no more than there are words.
2. Union. The machines of a range are expanded, sorted together and added up; phrases below ``LEAST`` are cut off.
3. Sieve. A phrase found so often has only parts found so often. So pairs are built of frequent words, and longer phrases
   where every pair is frequent. The frequent ones pass a set of bits of bounded size, built anew for each step; what passes
   by chance, or because the set is full, is counted like the rest and cut off in its union.

Parts of candidates are looked up in the range that owns them: the distinct parts of a range walk its machine. Scores,
containment, and the ranking are plain expressions and joins.

Results: a null text has no words, a null language is ``und``; repeated rows count as often as they occur; equal scores rank
by count, then by the bytes of the phrase; an empty table gives an empty result; other columns are left out. Arithmetic is in
whole numbers of 38 digits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .phrase_machines import Machine, added, built
from .shared import BASE, mixed, partitions, pieces_of, signed, utf8, written

LEAST = 30
LONGEST = 4
HELD = 80  # hundredths of a phrase's count that a longer one must have to hold it
UNKNOWN = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text cut into words at a time, words of a shard, bytes of text for each prefix range.
SLAB, SHARD, RANGE = 1 << 21, 1_250_000, 1 << 25
SIEVE_BITS = 1 << 24

LOWER = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
BREAK = re.compile(b"[" + re.escape(BREAKS) + b"]")
MACHINES = "lang string, depth int, range int, machine binary, words binary, total long, clash boolean"

Sieve = np.ndarray | None


# --- words of a shard ---


class _Words:
    """The words of one language, numbered, and the piece each stands in."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number))
        self.ids: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.waiting = self.size = self.piece = 0

    def add(self, text: bytes) -> None:
        at = 0
        while len(text) - at > SLAB:
            gap = BREAK.search(text, at + SLAB)
            if not gap:
                break
            self._take(text[at : gap.start()])
            at = gap.end()
        self._take(text[at:])

    def _take(self, text: bytes) -> None:
        self.texts.append(text)
        self.waiting += len(text) + 1
        if self.waiting > SLAB:
            self.cut()

    def cut(self) -> None:
        data = b"\n".join([*self.texts, b""]).translate(LOWER)
        codes = np.frombuffer(data, np.uint8)
        inside = (codes != 10) & (codes != 32)
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        pieces = np.cumsum(codes == 10, dtype=np.int32)[starts] + self.piece
        words = data.split()
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.pieces.append(pieces)
        self.piece += int(np.count_nonzero(codes == 10))
        self.size += len(words)
        self.texts, self.waiting = [], 0

    def done(self, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Word of each place as its rank by label, its piece, the labels in order and their words."""
        self.cut()
        words = list(self.number)
        labels = np.fromiter((xxhash.xxh3_64_intdigest(word, seed) | 1 for word in words), np.uint64, len(words))
        order = np.argsort(labels, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        return rank[np.concatenate(self.ids)], np.concatenate(self.pieces), labels[order], [words[i] for i in order]


def _key(lang: str, phrases: np.ndarray) -> np.ndarray:
    """A hash of each phrase in its language."""
    total = np.full(len(phrases), xxhash.xxh3_64_intdigest(lang), dtype=np.uint64)
    for column in phrases.T:
        total = total * BASE + column
    return mixed(total)


def _passes(sieve: Sieve, keys: np.ndarray) -> np.ndarray:
    if sieve is None:
        return np.ones(len(keys), dtype=bool)
    bit = keys % np.uint64(8 * len(sieve))
    return (sieve[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _phrases(depth: int, lang: str, word: np.ndarray, piece: np.ndarray, labels: np.ndarray, words: Sieve, pairs: Sieve):
    """Sorted distinct phrases of a step and their counts: of one word, of two, or of three and four."""
    if depth == 1:
        return labels[:, None], np.bincount(word, minlength=len(labels))
    often = _passes(words, _key(lang, labels[:, None]))[word]
    near = (piece[1:] == piece[:-1]) & often[1:] & often[:-1]
    size = len(labels) + 1
    two, of, times = np.unique((word[:-1] * size + word[1:])[near], return_inverse=True, return_counts=True)
    pair = np.stack([labels[two // size], labels[two % size]], axis=1)
    if depth == 2:
        return pair, times
    # Number of the frequent pair that begins at each place, -1 for none.
    begins = np.full(len(word) + 2, -1)
    begins[np.flatnonzero(near)] = np.where(_passes(pairs, _key(lang, pair)), np.arange(len(two)), -1)[of]
    three = (begins[:-2] >= 0) & (begins[1:-1] >= 0)
    four = three & (begins[2:] >= 0)
    at = np.flatnonzero(three)
    padded = np.concatenate([word, [0, 0, 0]])
    stems, stem, stem_times = np.unique(begins[at] * size + padded[at + 2], return_inverse=True, return_counts=True)
    last = padded[at[four[at]] + 3] + 1
    windows, times = np.unique(stem[four[at]] * size + last, return_counts=True)
    # A window of four words also counts for its first three.
    stem = np.concatenate([np.arange(len(stems)), windows // size])
    last = np.concatenate([np.zeros(len(stems), np.int64), windows % size])
    times = np.concatenate([stem_times, times])
    order = np.lexsort((last, stem))
    stem, last, times = stems[stem[order]], last[order], times[order]
    start, third = stem // size, labels[stem % size]
    fourth = np.where(last > 0, labels[np.maximum(last, 1) - 1], np.uint64(0))
    return np.concatenate([pair[start], third[:, None], fourth[:, None]], axis=1), times


def _ranges(phrases: np.ndarray, depth: int, ranges: int) -> np.ndarray:
    """Prefix range of each phrase."""
    return (_key("", phrases[:, : 1 if depth < 3 else 3]) % np.uint64(ranges)).astype(np.int64)


def _shards(depth: int, ranges: int, seed: int, words: Sieve, pairs: Sieve):
    """Machines of a task's texts, by language and prefix range."""

    def machines(found: dict[str, _Words]) -> Iterator[dict]:
        for lang, own in found.items():
            word, piece, labels, names = own.done(seed)
            if not len(word):
                continue
            phrases, counts = _phrases(depth, lang, word, piece, labels, words, pairs)
            if not len(phrases):
                continue
            place = _ranges(phrases, depth, ranges)
            order = np.argsort(place, kind="stable")
            bounds = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1))
            for a, b in zip(bounds, bounds[1:]):
                some = order[a:b]
                listed = b"\n".join(names[i] for i in some) if depth == 1 else None
                yield {"range": int(place[some[0]]), "machine": _machine(phrases[some], counts[some]), "words": listed, "lang": lang}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, _Words] = defaultdict(_Words)
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), utf8(batch["text"])):
                found[lang].add(text or b"")
                if sum(own.size for own in found.values()) >= SHARD:
                    yield from _rows(machines(found), depth)
                    found = defaultdict(_Words)
        yield from _rows(machines(found), depth)

    return run


def _machine(phrases: np.ndarray, counts: np.ndarray) -> bytes:
    """Equal labels of two words side by side (see ``clash``) are one phrase."""
    first = np.flatnonzero(np.concatenate([[True], (phrases[1:] != phrases[:-1]).any(axis=1)]))
    return built(phrases[first], np.add.reduceat(counts, first)).packed()


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema({name: kinds[kind] for name, kind in (column.split() for column in MACHINES.split(", "))})


def _rows(machines: Iterator[dict], depth: int) -> Iterator[pa.RecordBatch]:
    some: list[dict] = []
    for row in machines:
        some.append(row | {"depth": depth, "total": None, "clash": None})
        if len(some) == 64:
            yield pa.RecordBatch.from_pylist(some, _schema())
            some = []
    yield pa.RecordBatch.from_pylist(some, _schema())


def _united(table: pa.Table) -> pa.Table:
    """The machine of a language's range: the sum of its shards' machines, without rare phrases."""
    machines = [Machine.unpacked(data.as_py()) for data in table["machine"]]
    phrases, counts, total = added(machines, LEAST)
    row = {name: table[name][0].as_py() for name in ("lang", "depth", "range")}
    clash, listed = False, None
    if row["depth"] == 1:
        names: dict[int, bytes] = {}
        for machine, words in zip(machines, table["words"]):
            words = words.as_py().split(b"\n")
            labels = machine.labels.tolist()
            clash |= len(labels) != len(words)
            for label, word in zip(labels, words):
                clash |= names.setdefault(label, word) != word
        listed = b"\n".join(names[label] for label in phrases[:, 0].tolist())
    packed = built(phrases, counts).packed() if len(phrases) else None
    return pa.Table.from_pylist([row | {"machine": packed, "words": listed, "total": total, "clash": clash}], _schema())


# --- steps ---


def _ranges_for(size: int) -> int:
    return pieces_of(size, RANGE)


def machines_of(docs: DataFrame, depth: int, size: int, seed: int, words: Sieve = None, pairs: Sieve = None) -> DataFrame:
    """One machine for each language and prefix range."""
    ranges = _ranges_for(size)
    shards = docs.mapInArrow(_shards(depth, ranges, seed, words, pairs), MACHINES)
    # Tasks grow in number with the ranges, so that each reads a few of them at any size.
    dealt = shards.repartition(max(partitions(docs.sparkSession), ranges), "lang", "range")
    return written(dealt.groupBy("lang", "range").applyInArrow(_united, MACHINES), "machines")


PHRASES = "lang string, phrase array<long>, a long, key long, word binary"


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            phrases, counts = Machine.unpacked(row["machine"]).phrases()
            sizes = (phrases > 0).sum(axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(signed(phrases[phrases > 0]))
            )
            names = row["words"].split(b"\n") if row["words"] is not None else [None] * len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * len(counts), pa.string()), lists, pa.array(counts),
                    pa.array(signed(_key(row["lang"], phrases))), pa.array(names, pa.binary()),
                ],
                ["lang", "phrase", "a", "key", "word"],
            )


def phrases_of(machines: DataFrame) -> DataFrame:
    """The phrases that machines accept, as lists of labels, with their counts."""
    return machines.where("machine IS NOT NULL").select("lang", "machine", "words").mapInArrow(_expanded, PHRASES)


def sieve_of(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases' keys, 16 for each, SIEVE_BITS at most."""
    size = min(SIEVE_BITS, 1 << max(6, (16 * phrases.count()).bit_length()))
    place = F.expr(f"pmod(key, {size}L)")
    # Whole bytes of the set, at most SIEVE_BITS / 8 rows.
    cells = phrases.select(place.alias("bit")).groupBy(F.expr("bit div 8").alias("cell"))
    rows = cells.agg(F.expr("bit_or(shiftleft(1, CAST(bit % 8 AS INT)))").alias("byte")).toArrow()
    sieve = np.zeros(size // 8, dtype=np.uint8)
    sieve[rows["cell"].to_numpy()] = rows["byte"].to_numpy()
    return sieve


def _asked(ranges: int):
    """The parts with their depth and prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = _padded(batch["phrase"])
            depth = np.minimum((phrases > 0).sum(axis=1), 3)
            place = np.where(depth < 3, _ranges(phrases, 1, ranges), _ranges(phrases, 3, ranges))
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], pa.array(depth, pa.int32()), pa.array(place, pa.int32()), batch["phrase"]],
                ["lang", "depth", "range", "phrase"],
            )

    return run


def _padded(lists: pa.ListArray) -> np.ndarray:
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    phrases = np.zeros((len(sizes), LONGEST), dtype=np.uint64)
    phrases[np.arange(LONGEST) < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
    return phrases


def _answered(parts: pa.Table, machines: pa.Table) -> pa.Table:
    """The counts of a range's parts: each walks the range's machine."""
    if not parts.num_rows or not machines.num_rows:
        return parts.select(["lang", "phrase"]).slice(0, 0).append_column("f", pa.array([], pa.int64()))
    machine = Machine.unpacked(machines["machine"][0].as_py())
    phrases = _padded(parts["phrase"].combine_chunks())
    return parts.select(["lang", "phrase"]).append_column("f", pa.array(machine.counts(phrases[:, : len(machine.layers)])))


def looked_up(parts: DataFrame, machines: DataFrame, ranges: int) -> DataFrame:
    """lang, phrase and its count f, for distinct phrases."""
    asked = parts.distinct().mapInArrow(_asked(ranges), "lang string, depth int, range int, phrase array<long>")
    keys = ["lang", "depth", "range"]
    answers = asked.groupBy(*keys).cogroup(machines.where("machine IS NOT NULL").select(*keys, "machine").groupBy(*keys))
    return answers.applyInArrow(_answered, "lang string, phrase array<long>, f long")


# --- the operator ---


def _whole(name: str, factor: int = 1) -> str:
    return f"CAST({name} AS DECIMAL(19,0)) * CAST({factor} AS DECIMAL(7,0))"


def _scored(candidates: DataFrame, machines: DataFrame, ranges: int) -> DataFrame:
    """Candidates with l, r and score of their weakest cut."""
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(phrase) - 1)"))).selectExpr(
        "lang", "phrase", "a", "k", "slice(phrase, 1, k) AS head", "slice(phrase, k + 1, size(phrase) - k) AS rest"
    )
    parts = cuts.select("lang", F.explode(F.array("head", "rest")).alias("phrase"))
    counts = written(looked_up(parts, machines, ranges), "parts")
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    known = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"])
    score = f"CAST({_whole('a', 2_000_000)} div ({_whole('l')} + {_whole('r')}) AS BIGINT)"
    weakest = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut")
    return known.groupBy("lang", "phrase").agg(F.first("a").alias("a"), weakest).select("lang", "phrase", "a", "cut.*")


def _free(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate holds."""
    held = (
        candidates.where("size(phrase) > 2")
        .withColumn("size", F.explode(F.expr("sequence(2, size(phrase) - 1)")))
        .withColumn("start", F.explode(F.expr("sequence(1, size(phrase) - size + 1)")))
        .groupBy("lang", F.expr("slice(phrase, start, size)").alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    kept = candidates.join(held, ["lang", "phrase"], "left")
    return kept.where(f"longer IS NULL OR {_whole('longer', 100)} < {_whole('a', HELD)}").drop("longer")


def _named(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their words."""
    each = candidates.select("lang", "phrase", F.posexplode("phrase").alias("at", "label"))
    spelled = (
        each.join(words, ["lang", "label"])
        .groupBy("lang", "phrase")
        .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("lang", "phrase", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"))
    )
    return candidates.join(spelled, ["lang", "phrase"])


def collocations(docs: DataFrame, top: int | None = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language the best phrases of two to four words: lang, rank, phrase, a, l, r, n, score; all of them without ``top``."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, seed = _ranges_for(size), 0
    while (ones := machines_of(texts, 1, size, seed)).where("clash").head():
        seed += 1
    words = written(phrases_of(ones), "words")
    frequent = sieve_of(words)
    twos = machines_of(texts, 2, size, seed, frequent)
    pairs = written(phrases_of(twos), "pairs")
    threes = machines_of(texts, 3, size, seed, frequent, sieve_of(pairs))
    candidates = written(pairs.union(phrases_of(threes)).select("lang", "phrase", "a"), "candidates")
    scored = written(_scored(_free(candidates), ones.union(twos).union(threes), ranges), "scored")
    totals = ones.groupBy("lang").agg(F.sum("total").alias("n"))
    if top is not None:
        # Ties at the border go on; their phrases decide.
        scored = scored.withColumn("place", F.expr("rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC)"))
        scored = scored.where(F.col("place") <= top).drop("place")
    spelled = words.select("lang", F.col("phrase")[0].alias("label"), F.col("word").cast("string").alias("word"))
    ranked = _named(scored, spelled).withColumn(
        "rank", F.expr("CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text) AS BIGINT)")
    )
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
