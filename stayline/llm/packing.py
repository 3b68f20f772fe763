"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt evenly into blocks of ``BLOCK``. Each block evolves on ``ISLANDS`` islands, one task each. A gene is a
whole sequence: crossover injects the best-filled sequences of one parent into the other, dissolves sequences that hold
an injected piece a second time, lets displaced pieces take the place of smaller ones where they fill a sequence better, and
puts the rest back by best fit, longest first. Fewer sequences are fitter, then the larger mean square fill; no two of a
population are equally fit. A block that best fit packs into the fewest sequences its length allows needs no generation. Between epochs the best packing of each island migrates to the next island of its block (a join on block and
island). Pieces of sequences that stay below ``SETTLED`` of the capacity are pooled over all blocks, dealt anew and
evolved once more, so that rests of different blocks meet. Only lengths and row numbers travel; no task holds more than
a block and its population.

Results: pieces of the full capacity are sequences of their own; lengths must lie between 1 and the capacity; equal
lengths are interchangeable; an empty table gives an empty result; all columns of the pieces are kept, but for existing
ones named sequence_id or offset, which are replaced.
"""

from __future__ import annotations

import random
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import library_tokens
from .shared import pieces_of, written

BLOCK = 8192
ISLANDS = 2
EPOCHS = 2
#: Generations of an epoch at most, and those in a row that may gain nothing.
GENERATIONS, STALE = 300, 20
POPULATION = 6
#: Sequences that a repair looks at, pieces they may have, and displaced pieces tried in each.
REFILLED, FEW, TRIED = 400, 8, 200
SETTLED = 0.995
STATE = "block bigint, island int, keys binary, lengths binary, population binary, n_bins bigint"

Packing = list[list[int]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cuts: str = "byte_level") -> DataFrame:
    """Pieces of every whole text: its other columns, piece, start, length and ids (little-endian 32-bit).

    A text longer than the capacity is cut into pieces of it, of which the first may be shorter. A null text is empty and
    has only the end id.
    """

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:int,ids:binary>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = library_tokens.loaded(tokenizer, cuts)
        end = struct.pack("<I", end_id)
        kind = pa.list_(
            pa.struct({"piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids": pa.binary()})
        )
        for batch in batches:
            rows = []
            for first in range(0, len(batch), 1000):
                for row in encoder.encode(batch.slice(first, 1000)):
                    row += end
                    size = len(row) // 4
                    bounds = [0, *range(size % capacity or capacity, size + 1, capacity)]
                    rows.append(
                        [
                            {"piece": number, "start": a, "length": b - a, "ids": row[4 * a : 4 * b]}
                            for number, (a, b) in enumerate(zip(bounds, bounds[1:]))
                        ]
                    )
            yield pa.array(rows, kind)
        encoder.trim(library_tokens.WAITING)

    others = [F.col("`" + name.replace("`", "``") + "`") for name in docs.columns if name not in ("text", "piece", "start", "length", "ids")]
    return docs.select(*others, F.inline(cut("text")))


class Bins:
    """Sequences by the room left in them, for best fit in constant time."""

    def __init__(self, lengths: list[int], capacity: int, packing: Packing = ()):
        self.lengths, self.capacity = lengths, capacity
        self.by_room: list[Packing] = [[] for _ in range(capacity + 1)]
        self.rooms = 0
        for items in packing:
            self.put(items, capacity - sum(lengths[i] for i in items))

    def put(self, items: list[int], room: int) -> None:
        self.by_room[room].append(items)
        self.rooms |= 1 << room

    def fit(self, item: int) -> None:
        """Add an item to the fullest sequence that has room for it."""
        length = self.lengths[item]
        if open_rooms := self.rooms >> length:
            room = length + (open_rooms & -open_rooms).bit_length() - 1
            items = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms ^= 1 << room
        else:
            items, room = [], self.capacity
        items.append(item)
        self.put(items, room - length)

    def packing(self) -> Packing:
        return [items for same in self.by_room for items in same]


def best_fit(lengths: list[int], capacity: int, order: list[int], packing: Packing = ()) -> Packing:
    bins = Bins(lengths, capacity, packing)
    for item in order:
        bins.fit(item)
    return bins.packing()


def fitness(lengths: list[int], capacity: int, packing: Packing) -> float:
    return sum((sum(lengths[i] for i in items) / capacity) ** 2 for items in packing) / max(1, len(packing))


def _better(lengths: list[int], items: list[int], room: int, sizes: list[int]) -> tuple[list[int], list[int]] | None:
    """Of a sequence's pieces up to two that give way, and the places of up to two of the given lengths, in ascending order,
    that fill it best in their stead."""
    best, gain = None, 0
    for out in [[i] for i in items] + [[i, j] for at, i in enumerate(items) for j in items[:at]]:
        less = sum(lengths[i] for i in out)
        most = less + room
        at = bisect_right(sizes, most) - 1
        if at >= 0 and sizes[at] - less > gain:
            best, gain = (out, [at]), sizes[at] - less
        low, high = 0, at
        while low < high and gain < room:
            both = sizes[low] + sizes[high]
            if both > most:
                high -= 1
            else:
                if both - less > gain:
                    best, gain = (out, [low, high]), both - less
                low += 1
        if gain == room:
            break
    return best


def refilled(lengths: list[int], capacity: int, packing: Packing, displaced: list[int]) -> Packing:
    """Displaced pieces first take the place of smaller ones in sequences that they fill better, emptiest first; what is
    left over then goes in by best fit, longest first."""
    spare = sorted(displaced, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in spare]
    rooms = sorted(((capacity - sum(lengths[i] for i in items), at) for at, items in enumerate(packing)), reverse=True)
    for room, at in rooms[:REFILLED]:
        items = packing[at]
        if not room or not spare or len(items) > FEW:
            continue
        # A window of the spare pieces, from the longest down, is tried.
        start = max(0, len(spare) - TRIED)
        if found := _better(lengths, items, room, sizes[start:]):
            out, chosen = found
            packing[at] = [i for i in items if i not in out] + [spare[start + x] for x in chosen]
            for x in sorted(chosen, reverse=True):
                del spare[start + x], sizes[start + x]
            for i in out:
                place = bisect_right(sizes, lengths[i])
                spare.insert(place, i)
                sizes.insert(place, lengths[i])
    return best_fit(lengths, capacity, spare[::-1], packing)


def crossover(lengths: list[int], capacity: int, into: Packing, source: Packing, dice: random.Random) -> Packing:
    """Inject well-filled sequences of one packing into another and repair what they displace."""
    filled = sorted(source, key=lambda items: -sum(lengths[i] for i in items))
    well = filled[: max(1, len(filled) // 2)]
    injected = [items for items in well if dice.random() < 0.5] or well[:1]
    taken = {i for items in injected for i in items}
    kept, displaced = [], []
    for items in into:
        if taken.isdisjoint(items):
            kept.append(list(items))
        else:
            displaced.extend(i for i in items if i not in taken)
    # Mutation: the worst-filled sequences dissolve too, and a few others.
    kept.sort(key=lambda items: -sum(lengths[i] for i in items))
    worst = len(kept) // 20 + 1
    displaced.extend(i for items in kept[-worst:] for i in items)
    return refilled(lengths, capacity, [*kept[:-worst], *map(list, injected)], displaced)


def evolved(lengths: list[int], capacity: int, population: list[Packing], seed: int) -> list[Packing]:
    """Generations of tournaments and crossovers, until ``STALE`` of them in a row gain nothing. A child takes the place of
    the worst unless one as fit is there already. Best first."""
    dice = random.Random(seed)
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    least = -(-sum(lengths) // capacity)

    def scored(packing: Packing) -> tuple[int, float, Packing]:
        return len(packing), -fitness(lengths, capacity, packing), packing

    if not population:
        population = [best_fit(lengths, capacity, falling)]
    if min(map(len, population)) > least:
        while len(population) < POPULATION:
            # Ever less in order of length, so that parents differ.
            spread = 1 - 0.15 * len(population)
            order = sorted(falling, key=lambda i: -lengths[i] * dice.uniform(spread, 1.0))
            population.append(best_fit(lengths, capacity, order))
    ranked = sorted(map(scored, population), key=lambda x: x[:2])
    idle = 0
    for _ in range(GENERATIONS):
        if ranked[0][0] <= least or idle == STALE or len(ranked) < 2:
            break
        mother, father = dice.sample(range(len(ranked)), 2)
        child = scored(crossover(lengths, capacity, ranked[mother][2], ranked[father][2], dice))
        idle = 0 if child[:2] < ranked[0][:2] else idle + 1
        if all(child[:2] != other[:2] for other in ranked):
            ranked = sorted([*ranked, child], key=lambda x: x[:2])[:POPULATION]
    return [packing for _, _, packing in ranked]


def _stored(population: list[Packing], size: int) -> bytes:
    rows = np.zeros((len(population), size), dtype="<i4")
    for row, packing in zip(rows, population):
        for number, items in enumerate(packing):
            row[items] = number
    return rows.tobytes()


def _restored(data: bytes, size: int) -> list[Packing]:
    population = []
    for row in np.frombuffer(data, "<i4").reshape(-1, size):
        packing: Packing = [[] for _ in range(int(row.max()) + 1)]
        for item, number in enumerate(row.tolist()):
            packing[number].append(item)
        population.append(packing)
    return population


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's rows as one block, named by its smallest row number."""
    some = [(batch["row"].to_numpy(), batch["length"].to_numpy()) for batch in batches]
    if keys := [x for x, _ in some if len(x)]:
        key, length = np.concatenate(keys), np.concatenate([x for _, x in some if len(x)])
        order = np.argsort(key)
        key, length = key[order].astype("<i8"), length[order].astype("<i4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(key[0])]), pa.array([key.tobytes()], pa.binary()), pa.array([length.tobytes()], pa.binary())],
            ["block", "keys", "lengths"],
        )


def _epoch(number: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").tolist()
                population = _restored(row["population"], len(lengths)) if row["population"] else []
                if row["guest"]:
                    population = [*population[:-1], *_restored(row["guest"], len(lengths))]
                seed = hash((row["block"], row["island"], number))
                population = evolved(lengths, capacity, population, seed)
                row |= {"population": _stored(population, len(lengths)), "n_bins": len(population[0])}
                del row["guest"]
                yield pa.RecordBatch.from_pylist([row], schema=_schema())

    return run


def _schema() -> pa.Schema:
    return pa.schema(
        {
            "block": pa.int64(),
            "island": pa.int32(),
            "keys": pa.binary(),
            "lengths": pa.binary(),
            "population": pa.binary(),
            "n_bins": pa.int64(),
        }
    )


def _evolve(items: DataFrame, count: int, capacity: int, stage: int) -> DataFrame:
    """Sequences of each row: row, length, sequence_id, fill."""
    blocks = pieces_of(count, BLOCK)
    islands = (
        items.select("row", "length")
        .repartition(blocks)
        .mapInArrow(_blocks, "block bigint, keys binary, lengths binary")
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        .selectExpr("block", "island", "keys", "lengths", "cast(NULL AS binary) AS population", "0L AS n_bins")
    )
    size = F.length("lengths")
    for epoch in range(EPOCHS):
        if epoch:
            elite = islands.select(
                "block",
                F.expr(f"pmod(island + 1, {ISLANDS})").alias("island"),
                F.expr("substring(population, 1, length(lengths))").alias("guest"),
            )
            islands = islands.join(elite, ["block", "island"]).select(*islands.columns, "guest")
        else:
            islands = islands.withColumn("guest", F.lit(None).cast("binary"))
        islands = written(
            islands.repartition(blocks * ISLANDS, "block", "island").mapInArrow(_epoch(epoch, capacity), STATE), "islands"
        )
    best = islands.groupBy("block").agg(
        F.min_by(
            F.struct("keys", "lengths", F.substring("population", 1, size).alias("elite")), F.struct("n_bins", "island")
        ).alias("best")
    )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, lengths = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                bins = np.frombuffer(row["elite"], "<i4").astype(np.int64)
                fill = np.bincount(bins, lengths).astype(np.int64)
                order = np.lexsort((keys, bins))
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(bins[order], bins[order])
                offset = np.empty_like(bins)
                offset[order] = before - before[first]
                # Sequences are named by their first row: no two stages or blocks share a row.
                least = np.full(len(fill), np.iinfo(np.int64).max)
                np.minimum.at(least, bins, keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys, lengths, least[bins], offset, fill[bins])],
                    ["row", "length", "sequence_id", "offset", "fill"],
                )

    return written(
        best.select("best.*").mapInArrow(
            opened, "row bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"
        ),
        f"packed{stage}",
    )


def pack(rows: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Give every piece its sequence_id and its offset there."""
    kept = rows.select(*[name for name in rows.columns if name not in ("sequence_id", "offset")])
    # Written with its row numbers, so that they stay the same however often a part is read again.
    numbered = written(
        kept.select(F.struct("*").alias("piece_row"), F.col(length).cast("bigint").alias("length"))
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    short = numbered.where(F.col("length") < capacity).select("row", "length")
    places = numbered.where(F.col("length") == capacity).select(
        "row", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    for stage in (0, 1):
        if not (count := short.count()):
            break
        packed = _evolve(short, count, capacity, stage)
        settled = F.lit(True) if stage or count <= BLOCK else F.col("fill") >= SETTLED * capacity
        places = places.union(packed.where(settled).select("row", "sequence_id", "offset"))
        short = packed.where(~settled).select("row", "length")
    return numbered.join(places, "row").select("piece_row.*", "sequence_id", "offset")
