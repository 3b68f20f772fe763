"""Log-rank test of whether the retention curves of several segments differ.

Accounts are counted once per segment and tenure month, and that grid is written. Months are read off it; each segment's
row of at-risk counts then enters a month x month system as a product with itself, summed within tasks. So the number of
segments sets neither the size of a task's state nor what comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import few_rows, grouped, number
from ..sources import scratch
from .survival import tenure_grid

# Squared directions of the month x month matrix below this share of the largest count as zero.
SINGULAR = 1e-10
#: Tasks that add up the system, and segments that a task takes at a time.
TASKS, BLOCK = 32, 1024


@dataclass(frozen=True)
class Months:
    """Months that count: somebody left, and two or more accounts were at risk."""

    month: np.ndarray
    at_risk: np.ndarray
    chance: np.ndarray  # share of those at risk that left
    weight: np.ndarray  # covariance of two accounts' chances, times -1

    def rows(self, spark) -> DataFrame:
        values = zip(self.month, self.at_risk, self.chance, self.weight)
        rows = [(str(int(m)), number(n), number(c), number(w)) for m, n, c, w in values]
        names = ("month", "n", "chance", "weight")
        return few_rows(spark, names, rows) if rows else spark.createDataFrame([], "month int, n double, chance double, weight double")


def _grid(accounts: DataFrame, by: str) -> DataFrame:
    grid = tenure_grid(accounts, by).selectExpr("segment", "tenure_month", "accounts", "CAST(events AS BIGINT) AS events")
    return scratch.table(grid, "grid")


def _by_month(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = pa.Table.from_batches(batches, pa.schema({name: pa.int64() for name in ("tenure_month", "accounts", "events")}))
    sums = cells.group_by("tenure_month").aggregate([("accounts", "sum"), ("events", "sum")])
    yield from sums.select(["tenure_month", "accounts_sum", "events_sum"]).rename_columns(["month", "a", "d"]).to_batches()


def event_months(grid: DataFrame) -> Months:
    """A task sends one row for each month of its part of the grid."""
    cells = grid.selectExpr("CAST(tenure_month AS BIGINT) AS tenure_month", "accounts", "events")
    sums = cells.mapInArrow(_by_month, "month long, a long, d long").toArrow()
    month, place = np.unique(sums["month"].to_numpy(), return_inverse=True)
    accounts, left = np.zeros(len(month)), np.zeros(len(month))
    np.add.at(accounts, place, sums["a"].to_numpy())
    np.add.at(left, place, sums["d"].to_numpy())
    at_risk = np.cumsum(accounts[::-1])[::-1]
    counts = (at_risk > 1) & (left > 0)
    month, n, d = month[counts], at_risk[counts], left[counts]
    return Months(month, n, d / n, d * (n - d) / (n * n * (n - 1)))


def logrank_terms(accounts: DataFrame, by: str = "contract_type") -> DataFrame:
    """Observed and expected leavers per segment."""
    grid = _grid(accounts, by)
    months = event_months(grid).rows(grid.sparkSession)
    so_far = months.selectExpr("month", "sum(chance) OVER (ORDER BY month) AS hazard_so_far")
    # The last month up to an account's tenure tells what the account was expected to contribute.
    listed = so_far.agg(F.sort_array(F.collect_list(F.struct("month", "hazard_so_far"))).alias("months")).scalar()
    passed = "filter(months, m -> m.month <= tenure_month)"
    reached = grid.withColumn("months", listed).selectExpr(
        "segment", "accounts", "events",
        f"coalesce(element_at({passed}, -1).hazard_so_far, 0D) AS hazard_so_far",
        f"coalesce(element_at({passed}, -1).month = tenure_month, false) AS counts",
    )
    return grouped(
        reached,
        {"segment": "segment"},
        {"observed": "sum(CASE WHEN counts THEN events ELSE 0 END)", "expected": "sum(accounts * hazard_so_far)"},
    ).orderBy("segment")


def logrank_covariance(accounts: DataFrame, by: str = "contract_type") -> DataFrame:
    """The covariance of every segment's leavers with every other's: by definition a row per pair of segments."""
    grid = _grid(accounts, by)
    months = event_months(grid).rows(grid.sparkSession)
    cells = grouped(grid, {"segment": "segment"}, {"cells": "collect_list(struct(tenure_month, accounts))"})
    at_risk = "aggregate(cells, 0L, (total, cell) -> total + IF(cell.tenure_month >= month, cell.accounts, 0L))"
    listed = months.agg(F.collect_list(F.struct(*months.columns))).scalar()
    # A month before all others, in which nobody counts, so that every pair meets at least once.
    start = "array(struct(CAST(-1 AS INT) AS month, 0D AS n, 0D AS chance, 0D AS weight))"
    reached = (
        cells.withColumn("months", listed)
        .selectExpr("segment", "cells", f"inline(concat({start}, months))")
        .selectExpr("segment", "month", "n", "weight", f"IF(month < 0, 0L, {at_risk}) AS r")
        .filter("r > 0 OR month < 0")
    )
    peers = reached.selectExpr("segment AS peer", "month", "r AS s")
    same = "CASE WHEN segment = peer THEN n * r ELSE 0D END"
    return grouped(
        reached.join(peers, "month"),
        {"segment": "segment", "peer": "peer"},
        {"covariance": f"sum(weight * ({same} - CAST(r AS DOUBLE) * s))"},
    ).orderBy("segment", "peer")


def _system(months: Months):
    """A task's share of the system: one row."""
    count = len(months.month)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, right = np.zeros((count, count)), np.zeros(count)
        squares = segments = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                some = batch["cells"].slice(start, BLOCK)
                cells = some.flatten()
                row = np.repeat(np.arange(len(some)), np.asarray(some.value_lengths()))
                month, accounts, events = (cells.field(name).to_numpy() for name in ("tenure_month", "accounts", "events"))
                # Accounts by the number of months that count up to their tenure; those at risk reach the next one.
                reached = np.zeros((len(some), count + 1))
                np.add.at(reached, (row, np.searchsorted(months.month, month, side="right")), accounts)
                at_risk = np.cumsum(reached[:, ::-1], axis=1)[:, ::-1][:, 1:]
                gap = -(at_risk @ months.chance)
                np.add.at(gap, row, np.where(np.isin(month, months.month), events, 0))
                spread = at_risk @ (months.weight * months.at_risk)
                open_ = spread > 0
                a, gap, spread = (at_risk * np.sqrt(months.weight))[open_], gap[open_], spread[open_]
                matrix += (a / spread[:, None]).T @ a
                right += a.T @ (gap / spread)
                squares += float(gap @ (gap / spread))
                segments += len(some)
        yield pa.RecordBatch.from_pylist(
            [{"matrix": matrix.tobytes(), "rhs": right.tobytes(), "squares": float(squares), "segments": segments}]
        )

    return run


def logrank_test(
    accounts: DataFrame, by: str = "contract_type", groups: bool = False, grid: DataFrame | None = None
) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value as one row, for any number of segments.

    The covariance is a diagonal by segment less one product for each event month, so the system to solve has a row for
    each event month. With ``groups``, the segments' names too: for a few of them. A written grid saves counting.
    """
    grid = _grid(accounts, by) if grid is None else grid
    months = event_months(grid)
    cells = grouped(grid, {"segment": "segment"}, {"cells": "collect_list(struct(CAST(tenure_month AS BIGINT) AS tenure_month, accounts, events))"})
    parts = cells.select("cells").coalesce(TASKS).mapInArrow(
        _system(months), "matrix binary, rhs binary, squares double, segments long"
    ).collect()
    size = len(months.month)
    system = np.eye(size) - sum((np.frombuffer(part.matrix) for part in parts), np.zeros(size * size)).reshape(size, size)
    right = sum((np.frombuffer(part.rhs) for part in parts), np.zeros(size))
    statistic = sum(part.squares for part in parts)
    if size:
        statistic += float(right @ np.linalg.pinv(system, SINGULAR, hermitian=True) @ right)
    dof = max(0, sum(part.segments for part in parts) - 1)
    found = few_rows(
        grid.sparkSession,
        ("statistic", "degrees_of_freedom", "p_value"),
        [(number(statistic), str(dof), number(chi_square_tail(statistic, dof)))],
    )
    if not groups:
        return found
    return found.withColumn("groups", grid.agg(F.array_sort(F.collect_set("segment"))).scalar())


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x) for whole degrees of freedom, from its finite closed form."""
    if dof <= 0 or x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        tail, power = 0.0, 0.0
    else:
        tail, power = math.erfc(math.sqrt(half)), 0.5
    while power < dof / 2:
        tail += math.exp(power * math.log(half) - half - math.lgamma(power + 1))
        power += 1
    return tail
