"""Rows at given ranks by refining histograms, instead of sorting.

Rows are ordered by a number, then by a text. One aggregate counts the rows of some thousand intervals of the order; the
intervals that hold a wanted rank are counted anew, divided finer, all of them in one pass. Numbers are divided between the
smallest and the largest of an interval, texts by their next letters. An interval of a few rows is fetched; one of a
single key is done, however many rows share it. So two passes are the rule, no pass shuffles more than the intervals'
counts of each task, and the driver sees counts and a bounded number of keys.

The frame is read once a pass and must give the same rows each time: write it first if it is costly.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from ..functions.columns import grouped, literal, number, quoted
from ..sources import scratch

#: Intervals that one is divided into, letters that texts are divided by (16 hex digits each), rows that are fetched.
INTERVALS, LETTERS, FEW = 4096, 3, 4096
# monotonically_increasing_id keeps the place in its lower 33 bits.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Order:
    """Ascending order of rows: SQL of a double (NaN first, NULL last), then of a text without order of its own; each
    stratum for itself."""

    text: str
    value: str | None = None
    stratum: str | None = None

    def keyed(self, df: DataFrame, *columns: str) -> DataFrame:
        """The given columns and the order key: stratum, kind, value, text."""
        # Named first: each of them is costly to work out twice.
        given = df.selectExpr(
            *columns,
            f"{self.value or '0D'} + 0D AS _given",  # -0.0 equals 0.0
            f"CAST({self.text} AS STRING) AS _name",
            f"CAST({self.stratum or '0'} AS STRING) AS _stratum",
        )
        infinite = "CAST('Infinity' AS DOUBLE)"
        kind = f"""CASE WHEN _given IS NULL THEN 4 WHEN isnan(_given) THEN 0
            WHEN _given = -{infinite} THEN 1 WHEN _given = {infinite} THEN 3 ELSE 2 END"""
        kinds = given.selectExpr("*", f"{kind} AS _kind")
        return kinds.selectExpr(
            *columns,
            "_stratum",
            "_kind",
            "CASE WHEN _kind = 2 THEN _given ELSE 0D END AS _value",
            # Hex digits keep the order of bytes; a null text comes before the empty one.
            "coalesce('1' || hex(_name), '0') AS _text",
        )


@dataclass(frozen=True)
class Cut:
    """The row at a rank: its key, how many rows share that, and how many of those rank up to the cut."""

    stratum: str
    rank: int
    kind: int
    value: float
    text: str
    taken: int
    equal: int

    @property
    def same(self) -> str:
        return f"_stratum = {literal(self.stratum)} AND _kind = {self.kind} AND _value = {number(self.value)} AND _text = {literal(self.text)}"

    @property
    def before(self) -> str:
        """Holds for rows of greater keys in the stratum."""
        return f"""_stratum = {literal(self.stratum)} AND (_kind > {self.kind} OR _kind = {self.kind} AND (
            _value > {number(self.value)} OR _value = {number(self.value)} AND _text > {literal(self.text)}))"""


@dataclass(frozen=True)
class _Interval:
    """Rows of a stratum and kind: with values from low to high, or of one value with texts that begin alike."""

    stratum: str
    kind: int
    low: float
    high: float
    start: str | None

    @property
    def holds(self) -> str:
        rows = f"""_stratum = {literal(self.stratum)} AND _kind = {self.kind}
            AND _value >= {number(self.low)} AND _value <= {number(self.high)}"""
        return f"{rows} AND startswith(_text, {literal(self.start)})" if self.start else rows

    @property
    def part(self) -> str:
        return _part(self.low, self.high, self.start)


def _part(low: float, high: float, start: str | None) -> str:
    """The smaller interval that a row belongs to, as a text in the same order."""
    if start is not None:
        return f"substring(_text, 1, {len(start) + LETTERS})"
    if math.isinf(high - low):
        return "CASE WHEN _value > 0 THEN '1' ELSE '0' END"
    # Each step keeps the order of values, rounded as it is; those outside go to the ends.
    share = f"(_value - {number(low)}) / {number(high - low)} * {INTERVALS}D"
    return f"lpad(CAST(floor(greatest(0D, least({INTERVALS - 1}D, {share}))) AS STRING), 6, '0')"


def _cases(intervals: Collection[_Interval], then: Callable[[int, _Interval], str]) -> str:
    return "CASE " + " ".join(f"WHEN {x.holds} THEN {then(i, x)}" for i, x in enumerate(intervals)) + " END"


def _counted(keys: DataFrame, interval: str, part: str) -> list[Row]:
    """Counted smaller intervals in order, with their first and last key."""
    counts = grouped(
        keys.selectExpr("*", f"{interval} AS _interval", f"{part} AS _part").filter("_interval IS NOT NULL"),
        {name: name for name in ("_interval", "_stratum", "_kind", "_part")},
        {
            "rows": "count(1)",
            "low": "min(_value)", "high": "max(_value)", "first": "min(_text)", "last": "max(_text)",
        },
    )
    return sorted(counts.collect(), key=lambda row: (row._interval, row._stratum, row._kind, row._part))


def _at(rows: list[Row], ranks: list[int]) -> Iterator[tuple[Row, int]]:
    """For ascending ranks within ordered counts, the count that holds the rank, and the rank within it."""
    places = iter(rows)
    row, before = next(places), 0
    for rank in ranks:
        while rank > before + row.rows:
            before += row.rows
            row = next(places)
        yield row, rank - before


def cuts(df: DataFrame, order: Order, ranks: Callable[[int], list[int]]) -> list[Cut]:
    """The rows at the ascending ranks that ``ranks`` gives for a stratum's size, for strata that are few."""
    keys = order.keyed(df).filter("_stratum IS NOT NULL")
    found: list[Cut] = []
    # Of each interval the ranks wanted, in the stratum and in the interval.
    open_: dict[_Interval, list[tuple[int, int]]] = {}
    few: dict[_Interval, list[tuple[int, int]]] = {}

    def place(rows: list[Row], wanted: list[tuple[int, int]]) -> None:
        for (rank, _), (row, within) in zip(wanted, _at(rows, [inside for _, inside in wanted])):
            if (row.low, row["first"]) == (row.high, row["last"]):
                found.append(Cut(row._stratum, rank, row._kind, row.low, row["first"], within, row.rows))
                continue
            start = os.path.commonprefix([row["first"], row["last"]]) if row.low == row.high else None
            interval = _Interval(row._stratum, row._kind, row.low, row.high, start)
            (few if row.rows <= FEW else open_).setdefault(interval, []).append((rank, within))

    first = _counted(keys, "0", _part(-1.0, 0.0, None if order.value else ""))
    for stratum in dict.fromkeys(row._stratum for row in first):
        rows = [row for row in first if row._stratum == stratum]
        place(rows, [(rank, rank) for rank in ranks(sum(row.rows for row in rows))])
    while open_:
        intervals, open_ = open_, {}
        counted = _counted(keys, _cases(intervals, lambda i, x: str(i)), _cases(intervals, lambda i, x: x.part))
        for i, wanted in enumerate(intervals.values()):
            place([row for row in counted if row._interval == i], wanted)
    if few:
        kept = keys.selectExpr("*", f"{_cases(few, lambda i, x: str(i))} AS _interval").filter("_interval IS NOT NULL")
        names = ("_interval", "_stratum", "_kind", "_value", "_text")
        listed = sorted(grouped(kept, {name: name for name in names}, {"rows": "count(1)"}).collect())
        for i, wanted in enumerate(few.values()):
            rows = [row for row in listed if row._interval == i]
            for (rank, _), (row, within) in zip(wanted, _at(rows, [inside for _, inside in wanted])):
                found.append(Cut(row._stratum, rank, row._kind, row._value, row._text, within, row.rows))
    return sorted(found, key=lambda cut: (cut.stratum, cut.rank))


_KEYS = ("_stratum", "_kind", "_value", "_text")


def _numbered(ties: DataFrame) -> DataFrame:
    """Rows of equal keys numbered from 1, each key for itself: places in the written parts plus the parts before."""
    rows = scratch.table(ties.withColumn("_row", F.monotonically_increasing_id()), "ties").selectExpr(
        "*", f"shiftright(_row, {_PLACE_BITS}) AS _written"
    )
    keys = ", ".join(_KEYS)
    sizes = grouped(rows, {name: name for name in (*_KEYS, "_written")}, {"size": "count(1)"}).selectExpr(
        *_KEYS, "_written",
        f"coalesce(sum(size) OVER (PARTITION BY {keys} ORDER BY _written ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
    )
    placed = rows.selectExpr("*", f"row_number() OVER (PARTITION BY _written, {keys} ORDER BY _row) AS _place")
    return placed.join(F.broadcast(sizes), [*_KEYS, "_written"]).selectExpr("*", "_before + _place AS _number")


def with_cuts_before(df: DataFrame, order: Order, found: list[Cut], name: str) -> DataFrame:
    """Add the number of cuts whose row ranks before each row.

    Rows are compared with the cuts' keys and not moved. Only where a cut runs through rows of equal keys are those rows
    written and numbered.
    """
    columns = [quoted(column) for column in df.columns]
    keyed = order.keyed(df, *columns)

    def count(conditions: list[str]) -> str:
        return f"CAST({' + '.join([f'CASE WHEN {x} THEN 1 ELSE 0 END' for x in conditions] or ['0'])} AS INT) AS {quoted(name)}"

    before = [cut.before for cut in found]
    torn = [cut for cut in found if cut.taken < cut.equal]
    if not torn:
        return keyed.selectExpr(*columns, count(before))
    tied = f"coalesce({' OR '.join(dict.fromkeys(f'({cut.same})' for cut in torn))}, false)"
    through = [f"({cut.same}) AND _number > {cut.taken}" for cut in torn]
    whole = keyed.filter(f"NOT {tied}").selectExpr(*columns, count(before))
    return whole.unionByName(_numbered(keyed.filter(tied)).selectExpr(*columns, count(before + through)))
