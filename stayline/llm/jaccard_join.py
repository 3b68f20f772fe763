"""N-gram Jaccard join by adaptive multi-match prefixes.

Documents are sets of distinct five-word shingles; equal sets are one node, named by a hash of the set. Take any order of
all shingles and let a set of n lose at most n - ceil(t n) of them: two sets of similarity t or more share l shingles
within the first n - ceil(t n) + l of each. Longer prefixes thus require more shared shingles.

1. Sieve. In hash order, with l a tenth of the set, each block of documents sends every distinct prefix shingle once to
   a bucket; a set goes on if enough of its prefix occurs in other sets. Shingles shared inside a block are counted there,
   so a frequent passage costs one entry per block.
2. Order. The shingles of the sets left are counted and ordered from rare to frequent. Each set lengthens its prefix to
   the l of least estimated cost: the lists it has to be met in, plus the verification of the candidates, which are at
   most the list entries divided by l.
3. Stars. In rounds, each list's hub (a member with few shingles of its own, drawn anew) is the candidate of its
   members; a member verifies its most frequent hub if the two share l prefix shingles (l of the less demanding set). Verified links contract to components, and lists within one
   component are done. Most groups of copies collapse here without meeting in pairs.
4. Rest. In lists that still span components, members of short lists meet in pairs, and those that share l prefix shingles
   are verified. Long lists form clusters, whose sets meet once, block by block, inside
   tasks; only links that join components are sent on. So no link between different components is lost, whatever the
   rounds found.

Results: null and empty texts have 0 shingles and are linked with nothing; fewer than five words are one shingle; repeated
rows, and different texts with equal sets, share a component; a row without an id belongs to its set's component; a
component of rows without ids is null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import components
from .shared import KEYS, Words, document_keys, mixed, pieces_of, shingles, utf8, written

WIDTH = 5
SIMILAR = 75  # in hundredths
BUCKET = 1_000_000
LONGEST = 8
VERIFY = 4.0
SHORT = 64
BLOCK = 400_000
#: Documents of a sieve block, and rows that other steps take at a time.
SENT, ROWS = 2000, 500
FRUITFUL = 4  # a star round is followed by another while it merges one in so many of the open sets
_words = Words(lower=True)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    return (shingles(values, WIDTH) for values in _words.of(utf8(texts)))


def name_of(values: np.ndarray) -> int:
    """A set's name: a 64-bit hash of its sorted shingles, never 0."""
    return (xxhash.xxh3_64_intdigest(values.tobytes()) | 1) - (1 << 63)


def free(n):
    """How many of its shingles a set of n can lose: n - ceil(t n)."""
    return n - -(-SIMILAR * n // 100)


def asked(n):
    """The sieve's l."""
    return 1 + n // 10


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= SIMILAR * (len(left) + len(right) - both)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: hashes take several times the room of their texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, ROWS):
        found = [(len(x), name_of(x) if len(x) else None) for x in shingle_sets(batch["text"])]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["tie"],
                pa.array([n for n, _ in found], pa.int64()), pa.array([name for _, name in found], pa.int64()),
            ],
            ["doc_id", "tie", "n", "name"],
        )


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n shingles and the name of each document's set."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return texts.mapInArrow(_sets, "doc_id long, tie long, n long, name long")


def _sender(buckets: int):
    """Prefix shingles of a block, dealt to buckets; and how many of each set's are shared within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in _sliced(batches, SENT):
            prefixes: dict[int, np.ndarray] = {}
            for values in shingle_sets(batch["text"]):
                if len(values):
                    prefixes.setdefault(name_of(values), values[: free(len(values)) + asked(len(values))])
            if not prefixes:
                continue
            sizes = [len(x) for x in prefixes.values()]
            token = np.concatenate(list(prefixes.values()))
            name = np.repeat(np.array(list(prefixes), dtype=np.int64), sizes)
            order = np.argsort(token, kind="stable")
            token, name = token[order], name[order]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            times = np.bincount(np.cumsum(first) - 1)
            shared = np.repeat(times > 1, times)
            names, counts = np.unique(name[shared], return_counts=True)
            token, name = token[first], np.where(shared, 0, name)[first]
            place = (mixed(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            token, name, place = token[order], name[order], place[order]
            bounds = np.searchsorted(place, np.arange(buckets + 1))
            rows = [
                {"bucket": b, "tokens": token[x:y].tobytes(), "names": name[x:y].tobytes(), "shared": None}
                for b, (x, y) in enumerate(zip(bounds, bounds[1:]))
                if y > x
            ]
            if len(names):
                number += 1
                counted = {"tokens": None, "names": names.tobytes(), "shared": counts.astype(np.int64).tobytes()}
                rows.append({"bucket": (number * 7919 + int(names[0] & 0xFFFF)) % buckets, **counted})
            yield pa.RecordBatch.from_pylist(rows, _sent())

    return run


def _sent() -> pa.Schema:
    return pa.schema({"bucket": pa.int64(), "tokens": pa.binary(), "names": pa.binary(), "shared": pa.binary()})


PACKED = "shard long, names binary, counts binary"


def _received(shards: int):
    """Of a bucket: how many of each set's shingles occur in another set, as one packed row for each shard of names."""

    def run(table: pa.Table) -> pa.Table:
        shared = table["shared"].is_valid().to_pylist()
        token, name, names, counts = ([np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], [])
        for at, counted in enumerate(shared):
            own = np.frombuffer(table["names"][at].as_py(), np.int64)
            if counted:
                names.append(own)
                counts.append(np.frombuffer(table["shared"][at].as_py(), np.int64))
            else:
                name.append(own)
                token.append(np.frombuffer(table["tokens"][at].as_py(), np.uint64))
        token, name = np.concatenate(token), np.concatenate(name)
        if len(token):
            order = np.argsort(token, kind="stable")
            token, name = token[order], name[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            times = np.diff(np.concatenate([first, [len(token)]]))
            differ = (np.minimum.reduceat(name, first) != np.maximum.reduceat(name, first)) | (name[first] == 0)
            found, count = np.unique(name[np.repeat(differ, times) & (name != 0)], return_counts=True)
            names.append(found)
            counts.append(count)
        names, counts = np.concatenate(names), np.concatenate(counts).astype(np.int64)
        shard = (mixed(names.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        names, counts, shard = names[order], counts[order], shard[order]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = [(int(shard[x]), names[x:y].tobytes(), counts[x:y].tobytes()) for x, y in zip(starts, [*starts[1:], len(shard)])]
        return pa.table(
            {
                "shard": pa.array([x for x, _, _ in rows], pa.int64()),
                "names": pa.array([x for _, x, _ in rows], pa.binary()),
                "counts": pa.array([x for _, _, x in rows], pa.binary()),
            }
        )

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Of a shard of names: each set's count over all buckets."""
    names = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["names"]])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["counts"]])
    name, place = np.unique(names, return_inverse=True)
    return pa.table({"name": name, "shared": np.bincount(place, counts).astype(np.int64)})


def sieved(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of which enough prefix shingles occur in other sets."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = pieces_of(int(total * 0.35), BUCKET)
    shared = (
        docs.select("text")
        .mapInArrow(_sender(buckets), "bucket long, tokens binary, names binary, shared binary")
        .groupBy("bucket")
        .applyInArrow(_received(buckets), PACKED)
        .groupBy("shard")
        .applyInArrow(_summed, "name long, shared long")
    )
    # l of the smallest set that it can be linked with.
    least = F.expr(f"1 + ceil({SIMILAR} * n / 100) div 10")
    return nodes.join(shared, "name").where(F.col("shared") >= least).drop("shared")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema({"name": pa.int64(), "n": pa.int64(), "tokens": pa.binary()})
    for batch in _sliced(batches, ROWS):
        rows = []
        for values, name in zip(shingle_sets(batch["text"]), batch["name"].to_pylist()):
            if len(values) and name_of(values) == name:
                rows.append({"name": name, "n": len(values), "tokens": values.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, ROWS):
        values = [np.frombuffer(x.as_py(), np.int64) for x in batch["tokens"]]
        sizes = np.array([len(x) for x in values])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(values)),
                pa.array(np.repeat(batch["name"].to_numpy(), sizes)),
                pa.array(np.repeat(sizes, sizes)),
            ],
            ["token", "name", "n"],
        )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix of each set in order of frequency, lengthened to the least estimated cost. Shingles that no other set has
    come first and are known by number only."""
    for batch in _sliced(batches, ROWS):
        lists = batch["shared"]
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        times, tokens = (lists.flatten().field(name).to_numpy() for name in ("times", "token"))
        chosen, rows = [], []
        for at, (name, n) in enumerate(zip(batch["name"].to_pylist(), batch["n"].to_pylist())):
            own = slice(bounds[at], bounds[at + 1])
            alone = n - (own.stop - own.start)
            open_places = free(n) + 1 - alone
            if open_places <= 0:
                continue
            order = np.lexsort((tokens[own], times[own]))[: open_places + LONGEST - 1]
            entries = np.cumsum(times[own][order] - 1)
            best, least = 1, np.inf
            for l in range(1, min(LONGEST, len(order) - open_places + 1) + 1):
                met = float(entries[open_places + l - 2])
                cost = met + VERIFY * n * met / l / 100
                if cost < least:
                    best, least = l, cost
            order = order[: open_places + best - 1]
            chosen.append(tokens[own][order])
            rows.append((name, n, alone, best, len(order)))
        if rows:
            name, n, alone, best, sizes = (np.array(x, dtype=np.int64) for x in zip(*rows))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(alone, sizes)
            columns = [np.concatenate(chosen), *(np.repeat(x, sizes) for x in (name, n)), place, np.repeat(best, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["token", "name", "n", "place", "l"])


def prefixes(tokens: DataFrame) -> DataFrame:
    """Entries of the inverted lists: token, name, n, place (in the set's order), l."""
    entries = tokens.select("name", "tokens").mapInArrow(_exploded, "token long, name long, n long")
    times = entries.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    shared = (
        entries.join(times, "token")
        .groupBy("name", "n")
        .agg(F.collect_list(F.struct("times", "token")).alias("shared"))
    )
    return shared.mapInArrow(_prefixes, "token long, name long, n long, place long, l long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, ROWS):
        sides = [[np.frombuffer(x.as_py(), np.uint64) for x in batch[side]] for side in ("left", "right")]
        yield batch.filter(pa.array([linked(*pair) for pair in zip(*sides)], pa.bool_())).select(["a", "b"])


def verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs a, b of names whose sets are similar enough."""
    left = tokens.select(F.col("name").alias("a"), F.col("tokens").alias("left"))
    right = tokens.select(F.col("name").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verified, "a long, b long")


def _alike(left: str, right: str) -> Column:
    """Sizes that similar sets can have."""
    return F.expr(f"100 * least({left}, {right}) >= {SIMILAR} * greatest({left}, {right})")


def _merged(home: DataFrame, links: DataFrame) -> DataFrame:
    """name, home: the component of each name after links between names."""
    ends = links.join(home.select(F.col("name").alias("a"), F.col("home").alias("x")), "a").join(
        home.select(F.col("name").alias("b"), F.col("home").alias("y")), "b"
    )
    label = components.labels(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    moved = home.join(label.select(F.col("node").alias("home"), "label"), "home", "left")
    return written(moved.select("name", F.coalesce("label", "home").alias("home")), "homes")


def _draw(turn: int) -> Column:
    """Order in which members become hubs: those with few shingles of their own first, anew in every turn."""
    return F.expr(f"place / n + 0.1D * (turn - 1) * pmod(xxhash64(name, turn), 1000) / 1000".replace("turn", str(turn)))


def links(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """name, home: the component of each name that stands in a list."""
    home = written(entries.select("name").distinct().withColumn("home", F.col("name")), "homes")
    turn = 0
    while True:
        turn += 1
        placed = entries.join(home, "name")
        hub = F.min(F.struct(_draw(turn).alias("draw"), "name", "n", "home")).alias("hub")
        lists = placed.groupBy("token").agg(hub, F.min("home").alias("low"), F.max("home").alias("high"))
        lists = lists.where("low <> high").select("token", "hub")
        candidates = (
            placed.join(lists, "token")
            .where((F.col("home") != F.col("hub.home")) & _alike("n", "hub.n"))
            .groupBy("name", F.col("hub.name").alias("b"))
            .agg(F.count("*").alias("votes"))
            .groupBy("name")
            .agg(F.max(F.struct("votes", "b")).alias("best"))
        )
        candidates = written(candidates.select(F.col("name").alias("a"), F.col("best.b").alias("b")), "candidates")
        tried = candidates.count()
        if not tried:
            break
        found = written(verified(sharing(candidates, entries), tokens), "links")
        merges = found.count()
        if merges:
            home = _merged(home, found)
        if merges * FRUITFUL < tried:
            break
    placed = entries.join(home, "name")
    spans = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("home").alias("low"), F.max("home").alias("high"))
    open_lists = written(placed.join(spans.where("low <> high").select("token", "size"), "token"), "open")
    short = _short_links(open_lists.where(F.col("size") <= SHORT), tokens)
    long = _long_links(open_lists.where(F.col("size") > SHORT), home, tokens)
    found = written(short.union(long), "links")
    return home if found.isEmpty() else _merged(home, found)


def _matched(meetings: DataFrame) -> DataFrame:
    """The pairs a, b of meetings in a list (token, n, place and l of both sides) that share l prefix shingles."""
    shortest = F.least("l1", "l2")

    def within(side: str) -> Column:
        return F.col(f"place{side}") < F.expr(f"n{side} - ceil({SIMILAR} * n{side} / 100)") + shortest

    return (
        meetings.where(within("1") & within("2"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("matches"), F.first(shortest).alias("l"))
        .where("matches >= l")
        .select("a", "b")
    )


def _side(entries: DataFrame, name: str, side: str, *others: str) -> DataFrame:
    return entries.select("token", F.col("name").alias(name), *[F.col(x).alias(f"{x}{side}") for x in ("n", "place", "l", *others)])


def sharing(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Of candidate pairs those that share l prefix shingles; no other can be similar enough."""
    return _matched(pairs.join(_side(entries, "a", "1"), "a").join(_side(entries, "b", "2"), ["b", "token"]))


def _short_links(entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links between members of short lists: pairs that share l prefix shingles, verified."""
    left, right = _side(entries, "a", "1", "home"), _side(entries, "b", "2", "home")
    met = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("home1") != F.col("home2")) & _alike("n1", "n2"))
    return verified(_matched(met), tokens)


def _long_links(entries: DataFrame, home: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links between members of long lists, enough to join what they join.

    Lists that share members form clusters; the sets of a cluster meet once, block by block, whatever the number of
    lists they share. Inside a pair of blocks only links that join components not yet joined there are sent on.
    """
    hubs = entries.groupBy("token").agg(F.min("name").alias("hub"))
    edges = entries.join(hubs, "token").select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct()
    cluster = components.labels(edges).select(F.col("node").alias("name"), F.col("label").alias("cluster"))
    members = written(cluster.join(home, "name").join(tokens, "name"), "members")
    blocks = members.groupBy("cluster").agg(F.expr(f"greatest(1, ceil(sum(n) / {BLOCK}))").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("block", F.expr("pmod(xxhash64(name), blocks)"))
    return (
        dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "name",
            "home",
            "tokens",
        )
        .groupBy("cluster", "low", "high")
        .applyInArrow(_met, "a long, b long")
    )


def _met(table: pa.Table) -> pa.Table:
    """Links within a block (low = high) or between two."""
    block, name, home = (table[x].to_numpy() for x in ("block", "name", "home"))
    values = [np.frombuffer(x.as_py(), np.uint64) for x in table["tokens"]]
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := parent.get(x, x)) != x:
            parent[x] = parent.get(above, above)
            x = above
        return x

    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        sizes = np.array([len(values[i]) for i in right])
        token = np.concatenate([values[i] for i in right])
        order = np.argsort(token, kind="stable")
        token, holder = token[order], np.repeat(np.arange(len(right)), sizes)[order]
        for i in left:
            own = values[i]
            first, last = np.searchsorted(token, own), np.searchsorted(token, own, side="right")
            times = last - first
            at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            both = np.bincount(holder[at], minlength=len(right))
            linked_to = np.flatnonzero((100 * both >= SIMILAR * (len(own) + sizes - both)) & (home[right] != home[i]))
            for j in right[linked_to]:
                x, y = root(int(home[i])), root(int(home[j]))
                if x != y:
                    parent[x] = y
                    found.append((int(name[i]), int(name[j])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _homes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as of ``sets``; and name, place (the first document, those without an id last) and home of each set: sets of
    one home are linked."""
    rows = written(sets(docs), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    nodes = (
        rows.where("n > 0")
        .groupBy("name")
        .agg(F.first("n").alias("n"), F.min(place).alias("place"))
        .select("name", "n", "place.doc_id", "place.tie")
    )
    nodes = written(nodes, "nodes")
    keys = document_keys("doc_id", "tie")
    left = sieved(docs, nodes).select("name", *keys)
    # One row of each document is enough. Grouped by the join's keys, so that texts are shuffled once.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    single = texts.groupBy(*keys).agg(F.first("text").alias("text"))
    tokens = written(
        single.join(left, KEYS)
        .select("name", "text")
        .mapInArrow(_tokens, "name long, n long, tokens binary"),
        "tokens",
    )
    entries = written(prefixes(tokens), "entries")
    home = links(entries, tokens)
    return rows, nodes.join(home, "name", "left").select(
        "name", place.alias("place"), F.coalesce("home", "name").alias("home")
    )


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles and component_id (the smallest doc_id reachable) of each document."""
    rows, homes = _homes(docs)
    smallest = homes.groupBy("home").agg(F.min("place.doc_id").alias("component_id"))
    component = homes.join(smallest, "home").select("name", "component_id")
    return rows.join(component, "name", "left").select(
        "doc_id",
        "tie",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group stays, with all its columns: one of the smallest doc_id, of a group without ids any one text.
    Rows without words stay."""
    _, homes = _homes(docs)
    first = homes.groupBy("home").agg(F.min("place").alias("place")).select("place.doc_id", "place.tie")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Repeated rows are taken together before the shuffle, and by the join's keys, so that texts are shuffled once.
    each = docs.where(worded).select(
        F.struct("*").alias("document"), F.col("doc_id").cast("bigint").alias("id_"), F.xxhash64("text").alias("tie_")
    )
    each = each.groupBy(*document_keys("id_", "tie_")).agg(F.first("document").alias("document"))
    kept = each.join(first.select(*document_keys("doc_id", "tie")), KEYS).select("document.*")
    return docs.where(~worded).union(kept)
