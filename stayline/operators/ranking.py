"""Exact ranks over all accounts without a single-task window, and an exact random split.

Rows are range-partitioned on the full sort key, which the row id makes unique, so neither
tied scores nor copies of an account can pile up in one partition. Each sorted row gets a
number that already holds its partition and its place inside it; the rank is that place
plus the sizes of the partitions before, a frame of one row per partition.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..assumptions import DEFAULTS
from ..functions.columns import grouped, literal, quoted, ratio
from ..sources import scratch
from . import selection

ROW = "_row"
STRATUM = "is_churned"
_PLACE = "_place"
_PART = "_part"
_FIRST = "_first"
# monotonically_increasing_id keeps the place in its lower 33 bits.
_PLACE_BITS = 33


def with_row_ids(df: DataFrame) -> DataFrame:
    """The frame as a written table with a row id, the last tie-break of every ranking.

    Written, so that the ids stay the same when a task is run again.
    """
    return scratch.table(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in a unique global order, as a written table that knows each row's partition and place."""
    in_order = rows.orderBy(*order).withColumn(_PLACE, F.monotonically_increasing_id())
    return scratch.table(in_order, "sorted").selectExpr("*", f"shiftright({_PLACE}, {_PLACE_BITS}) AS {_PART}")


def _starts(placed: DataFrame, size: str) -> DataFrame:
    """What the partitions before each one hold, and the total: at most spark.sql.shuffle.partitions rows."""
    earlier = f"(ORDER BY {_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return grouped(placed, {_PART: _PART}, {"size": size}).selectExpr(
        _PART, f"coalesce(sum(size) OVER {earlier}, 0) AS {_FIRST}", "sum(size) OVER () AS n"
    )


def number(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Add 1-based ``rn`` by the given order, and the row count ``n``, to rows with ids."""
    placed = _placed(rows, *order, ROW)
    return (
        placed.join(F.broadcast(_starts(placed, "count(1)")), _PART)
        .withColumn("rn", F.expr(f"{_FIRST} + ({_PLACE} & {(1 << _PLACE_BITS) - 1}L) + 1"))
        .drop(_PART, _PLACE, _FIRST)
    )


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    return number(with_row_ids(df), *order).drop(ROW)


def auc(df: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """Exact Mann-Whitney area under the ROC curve; tied scores count half.

    Rows collapse to one per distinct score, partly before the shuffle. Scores are then ranked
    with all their rows at the mean rank, in whole-number arithmetic.
    """
    keys = {by: quoted(by)} if by else {}
    tied = grouped(df, {**keys, "score": quoted(score)}, {"positives": f"sum({quoted(label)})", "size": "count(1)"})
    placed = _placed(tied, *keys, "score")
    order = ", ".join([*keys.values(), "score"])
    before = f"sum(size) OVER (PARTITION BY {_PART} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranks = (
        placed.selectExpr("*", f"coalesce({before}, 0) AS _before")
        .join(F.broadcast(_starts(placed, "sum(size)")), _PART)
        .selectExpr(*keys.values(), "positives", "size", f"{_FIRST} + _before + 1 AS first_rank")
    )
    sums = grouped(
        ranks,
        keys,
        {
            "positives": "CAST(sum(positives) AS DECIMAL(18,0))",
            "negatives": "CAST(sum(size - positives) AS DECIMAL(18,0))",
            "twice_ranks": "sum(CAST(positives AS DECIMAL(18,0)) * CAST(2 * first_rank + size - 1 AS DECIMAL(19,0)))",
            "first_rank": "CAST(min(first_rank) AS DECIMAL(18,0))",
        },
    )
    # Ranks run through all groups: shift each group's to start at one.
    shift = "positives * CAST(2 * (first_rank - 1) + positives + 1 AS DECIMAL(19,0))"
    pairs = "2 * CAST(positives AS DOUBLE) * CAST(negatives AS DOUBLE)"
    areas = sums.selectExpr(*keys.values(), f"{ratio(f'(twice_ranks - {shift})', pairs)} AS auc")
    return areas.orderBy(*keys) if keys else areas


def stratified_split(
    df: DataFrame, key: str = "customer_id", share: str = DEFAULTS.test_share, seed: int = DEFAULTS.seed
) -> DataFrame:
    """Add ``split``: exactly the given share, rounded, of leavers and of stayers is 'test'.

    Rows are drawn in the order of a hash of key and seed. The last drawn key of each stratum is selected by histograms and
    the rows are compared with it: nothing is sorted or moved. The frame is read a few times, so write it first if it is
    costly; of rows with one key no choice is made beyond their number.
    """
    draw = f"md5(CAST({quoted(key)} AS STRING) || {literal(f'|{seed}')}) || '|' || CAST({quoted(key)} AS STRING)"
    order = selection.Order(text=draw, stratum=STRATUM)
    last = selection.cuts(df, order, lambda size: [rank for rank in [share_of_whole(size, share)] if rank])
    drawn = " OR ".join([f"CAST({STRATUM} AS STRING) = {literal(cut.stratum)}" for cut in last] or ["false"])
    columns = [quoted(name) for name in df.columns]
    return selection.with_cuts_before(df, order, last, "_after").selectExpr(
        *columns, f"CASE WHEN _after = 0 AND ({drawn}) THEN 'test' ELSE 'train' END AS split"
    )


def share_of_whole(count: int, share: str) -> int:
    """The whole number nearest to count * share, halves up."""
    return int((count * Decimal(share) + Decimal("0.5")) // 1)
