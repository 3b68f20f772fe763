"""SQL expression texts shared by the operators.

Expressions are Spark SQL text: one string is parsed into one built-in, code-generated
expression, which also keeps building a wide projection cheap on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MONEY = "DECIMAL(20,2)"

# Tenure bands as (label, first month past the band).
TENURE_BANDS = (
    ("0-6m", 6),
    ("6-12m", 12),
    ("12-24m", 24),
    ("24-48m", 48),
    ("48-72m", 72),
    ("72m+", None),
)


def named(expressions: Mapping[str, str]) -> list[str]:
    return [f"{sql} AS {quoted(name)}" for name, sql in expressions.items()]


def columns(expressions: Mapping[str, str]) -> list[Column]:
    return [F.expr(text) for text in named(expressions)]


def grouped(df: DataFrame, keys: Mapping[str, str], measures: Mapping[str, str]) -> DataFrame:
    """Aggregate by named key expressions; without keys the whole frame is one group."""
    return df.groupBy(*columns(keys)).agg(*columns(measures))


def few_rows(spark: SparkSession, names: Iterable[str], rows: Iterable[Iterable[str]]) -> DataFrame:
    """A handful of rows of literal texts as a relation the optimizer can fold."""
    values = ", ".join(f"({', '.join(row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(map(quoted, names))})")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | None) -> str:
    """A double literal, NULL if undefined; plain decimals in SQL text would be DECIMAL."""
    known = value is not None and math.isfinite(value)
    return f"CAST({repr(float(value)) if known else 'NULL'} AS DOUBLE)"


def flag(condition: str) -> str:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def trimmed(text: str) -> str:
    """Strip every kind of ASCII blank, not only spaces."""
    return f"btrim({text}, ' \\t\\n\\r\\u000B\\u000C')"


def lenient_number(text: str, precision: int, scale: int) -> str:
    """Decimal value of a text field; NULL for blanks and for anything unparsable."""
    return f"try_cast(nullif({trimmed(text)}, '') AS DECIMAL({precision},{scale}))"


def lenient_whole(text: str) -> str:
    """Whole number of a field that may be text; NULL for blanks, fractions and anything unparsable."""
    value = lenient_number(f"CAST({text} AS STRING)", 12, 2)
    return f"CASE WHEN {value} = floor({value}) THEN try_cast({value} AS INT) END"


def ratio(top: str, bottom: str) -> str:
    """Double division, NULL when the denominator is zero."""
    return f"CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0D)"


def _where(condition: str | None) -> str:
    return f" FILTER (WHERE {condition})" if condition else ""


def money_total(value: str, where: str | None = None) -> str:
    """Exact decimal sum; NULL when no row qualifies."""
    return f"CAST(sum({value}){_where(where)} AS {MONEY})"


def money_or_zero(value: str, where: str | None = None) -> str:
    return f"CAST(coalesce(sum({value}){_where(where)}, 0) AS {MONEY})"


def mean(value: str, where: str | None = None) -> str:
    """Mean as exact sum over count, so that decimals lose no digits on the way."""
    return ratio(f"sum({value}){_where(where)}", f"count({value}){_where(where)}")


def tenure_band(months: str) -> str:
    return _band(months, [literal(label) for label, _ in TENURE_BANDS])


def tenure_band_order(months: str) -> str:
    return _band(months, [str(position) for position in range(1, len(TENURE_BANDS) + 1)])


def _band(months: str, values: list[str]) -> str:
    rungs = [f"WHEN {months} < {end} THEN {value}" for (_, end), value in zip(TENURE_BANDS, values) if end]
    return f"CASE {' '.join(rungs)} ELSE {values[-1]} END"


def annuity(months: str, monthly_rate: float) -> str:
    """Present value of one unit a month, months rounded half to even."""
    whole = f"rint(CAST({months} AS DOUBLE))"
    rate = number(monthly_rate)
    worth = f"(1 - power(1 + {rate}, -{whole})) / {rate}" if monthly_rate else whole
    return f"CASE WHEN {whole} < 1 THEN 0D ELSE {worth} END"


def decile(rank: str, population: str) -> str:
    """Tenths of ranks 1..n cut at 1 + (n - 1) * j / 10, a boundary going to the lower tenth.

    Not ntile: the sizes differ, e.g. 705, 704, 704, 704, 705, ... for 7,043 ranks.
    """
    span = f"({population} - 1)"
    steps = f"(({rank} - 1) * 10 + {span} - 1) div nullif({span}, 0)"
    return f"CAST(greatest(1, coalesce({steps}, 1)) AS INT)"
