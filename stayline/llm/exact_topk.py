"""Exact top-k inner-product search by distributed histogram selection.

Vectors are packed into blocks, queries into smaller ones, and every pair of blocks is scored as one matrix product.
Scores are whole numbers, so the k-th best of each query is found by refining a histogram: a pass counts scores in
``BINS`` equal parts of the interval that is known to hold the k-th value, the parts are summed over all blocks, and the
part in which the k-th value lies is the next interval, until it holds one value. A block sends only its top parts, down
to its own k-th score in the interval: the k-th of all scores cannot lie lower. A last pass keeps the scores above that
value and, of those equal to it, the smallest ids.

Candidate blocks are spread over tasks by a salt and the query blocks are repeated for each salt, so neither a frequent
vector nor a frequent length gathers in a task.

Results: vectors that are null, or that hold a null or a component that is not finite, take no part; vectors meet only
vectors of their own length (empty ones score 0); a query's own id is no candidate; repeated rows are all candidates,
and a repeated query id is answered once per row; rows without an id take no part; fewer than k candidates are all
returned. Scores beyond 64 bits are not supported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import partitions, written

CANDIDATES = 4096
QUERIES = 512
BINS = 256
EXACT = 1 << 53


def whole_vectors(df: DataFrame, name: str, vector: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each usable vector."""
    usable = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    )
    return df.where(usable & F.col(name).isNotNull()).select(
        F.col(name).cast("bigint").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"),
    )


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"dim": pa.int32(), "ids": pa.binary(), "vectors": pa.binary()})
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dim)
            return pa.RecordBatch.from_pylist(
                [{"dim": dim, "ids": np.array(ids, "<i8").tobytes(), "vectors": np.array(rows, "<i8").tobytes()}], schema
            )

        for batch in batches:
            for name, row in zip(batch["id"].to_pylist(), batch["vector"].to_pylist()):
                ids, rows = waiting.setdefault(len(row), ([], []))
                ids.append(name)
                rows.append(row)
                if len(ids) == size:
                    yield block(len(row))
        for dim in list(waiting):
            yield block(dim)

    return run


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, scores (query x candidate) and which of them count."""
    dim = row["dim"]
    queries, ids = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    left = np.frombuffer(row["query_vectors"], "<i8").reshape(len(queries), dim)
    right = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), dim)
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, dim)
    if most < EXACT:
        scores = (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    else:
        scores = left @ right.T
    return queries, ids, scores, ids[None, :] != queries[:, None]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            queries, _, scores, counts = _scores(row)
            low, width, need = (np.frombuffer(row[x], "<i8") for x in ("low", "width", "need"))
            part = (scores - low[:, None]) // width[:, None]
            counts &= (part >= 0) & (part < BINS)
            flat = (np.arange(len(queries))[:, None] * BINS + part)[counts]
            table = np.bincount(flat, minlength=len(queries) * BINS).reshape(-1, BINS)
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            query, place = np.nonzero((table > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(query), row["query_block"])),
                    pa.array(query),
                    pa.array(place),
                    pa.array(table[query, place]),
                ],
                ["query_block", "query", "part", "n"],
            )


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            queries, ids, scores, counts = _scores(row)
            low, need = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["need"], "<i8")
            above = counts & (scores > low[:, None])
            query, place = np.nonzero(above)
            equal_query, equal_place = np.nonzero(counts & (scores == low[:, None]))
            order = np.lexsort((ids[equal_place], equal_query))
            equal_query, equal_place = equal_query[order], equal_place[order]
            nth = np.arange(len(equal_query)) - np.searchsorted(equal_query, equal_query)
            kept = nth < need[equal_query]
            query = np.concatenate([query, equal_query[kept]])
            place = np.concatenate([place, equal_place[kept]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(query), row["query_block"])),
                    pa.array(query),
                    pa.array(queries[query]),
                    pa.array(ids[place]),
                    pa.array(scores[query, place]),
                ],
                ["query_block", "query", "query_id", "id", "score"],
            )


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's next interval: the part of the summed histogram that holds its k-th value."""
    schema = pa.schema({"query_block": pa.int64(), "low": pa.binary(), "width": pa.binary(), "need": pa.binary()})
    for batch in batches:
        for row in batch.to_pylist():
            low, width, need = (np.frombuffer(row[x], "<i8").copy() for x in ("low", "width", "need"))
            table = np.zeros((len(low), BINS), dtype=np.int64)
            for cell in row["cells"] or ():
                table[cell["query"], cell["part"]] = cell["n"]
            through = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
            enough = through[:, 0] >= need
            # The lowest part if there are fewer than k: then everything down to it is taken.
            place = np.where(enough, (through >= need[:, None]).sum(axis=1) - 1, 0)
            rows = np.arange(len(low))
            need -= through[rows, place] - table[rows, place]
            low += place * width
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "query_block": row["query_block"],
                        "low": low.tobytes(),
                        "width": np.maximum(1, width // BINS).tobytes(),
                        "need": need.tobytes(),
                    }
                ],
                schema,
            )


def salt(salts: int) -> Column:
    """A number below ``salts`` for each row. Row numbers of one partition follow each other and those of another begin at
    a multiple of a power of two, so they are hashed."""
    return F.expr(f"cast(pmod(xxhash64(monotonically_increasing_id()), {salts}) AS int)")


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), id, score. Both inputs: id, vector (bigints)."""
    spark = candidates.sparkSession
    salts = partitions(spark)
    kind = "dim int, ids binary, vectors binary"
    blocks = written(
        candidates.mapInArrow(_packed(CANDIDATES), kind).withColumn("salt", salt(salts)),
        "candidates",
    )
    asked = written(
        queries.repartition(max(1, salts // 4))
        .mapInArrow(_packed(QUERIES), kind)
        .select(
            "dim",
            F.col("ids").alias("query_ids"),
            F.col("vectors").alias("query_vectors"),
            F.monotonically_increasing_id().alias("query_block"),
        ),
        "queries",
    )
    longest = candidates.select("vector").union(queries.select("vector")).agg(
        F.max(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    ).first()[0]
    bound = math.ceil(longest or 0) + 1  # no inner product is larger than the largest square

    def repeated(value: int) -> Column:
        return F.expr(f"unhex(repeat('{value.to_bytes(8, 'little', signed=True).hex()}', cast(length(query_ids) / 8 AS int)))")

    # A power of BINS, so that the parts of an interval are cut into whole parts again down to single values.
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    state = written(
        asked.select("query_block", repeated(-bound).alias("low"), repeated(width).alias("width"), repeated(k).alias("need")),
        "state",
    )

    def pairs(state: DataFrame) -> DataFrame:
        each = asked.join(state, "query_block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return blocks.join(each, ["dim", "salt"])

    while True:
        counts = (
            pairs(state)
            .mapInArrow(_histograms, "query_block bigint, query bigint, part bigint, n bigint")
            .groupBy("query_block", "query", "part")
            .agg(F.sum("n").alias("n"))
            .groupBy("query_block")
            .agg(F.collect_list(F.struct("query", "part", "n")).alias("cells"))
        )
        state = written(
            state.join(counts, "query_block", "left").mapInArrow(
                _narrowed, "query_block bigint, low binary, width binary, need binary"
            ),
            "state",
        )
        if width == 1:
            break
        width //= BINS
    found = pairs(state).mapInArrow(
        _chosen, "query_block bigint, query bigint, query_id bigint, id bigint, score bigint"
    )
    best = Window.partitionBy("query_block", "query").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
