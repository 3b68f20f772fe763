"""Quality rules: a decision list learned from labelled text statistics, applied as one Spark conditional expression.

Statistics are native array expressions over each whole text. Learning is sequential covering: a rule grows by the
threshold condition with the highest information gain until it covers no good document of the growing rows, is pruned
from its end against the pruning rows, and is kept if it is precise; then the rows it covers are set aside and the next
rule grows. The list becomes ``CASE WHEN`` conditions in the order in which they were learned. Only the bounded sample of
labelled statistics (``SAMPLE`` rows of a few numbers, taken by hash) reaches the driver.

Results: null and empty texts have no words and every count 0, and fail the base rule; repeated rows are judged alike;
without usable labels no rule is learned and the base rule alone decides; ties between conditions go to the first
statistic and the smallest threshold; existing columns of the outputs' names are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE = 20_000
RULES = 12
CONDITIONS = 4
PRECISION = 0.95
SUPPORT = 3
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions can be about: expressions of the statistics.
MEASURES = {
    "words": "cast(n_words AS double)",
    "word_length": "coalesce(word_chars / nullif(n_words, 0), 0D)",
    "symbols": "coalesce(n_symbols / nullif(word_chars, 0), 0D)",
    "repeated": "coalesce(n_repeat_words / nullif(n_words, 0), 0D)",
    "duplicate_lines": "coalesce(n_dup_lines / nullif(n_words, 0), 0D)",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

_WORDS = r"filter(split({text}, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
# Windows are sorted by hash, with the place in the low bits, so that equal ones become neighbours. Neighbours of equal
# hash are compared word by word; should two ever differ, the windows themselves are sorted instead.
_BY_HASH = """sort_array(transform(sequence(0, size(s.h) - 5), i ->
    shiftleft(xxhash64(s.h[i], s.h[i + 1], s.h[i + 2], s.h[i + 3], s.h[i + 4]), s.b) | i))"""
_SAME = "shiftright(x, s.b) = shiftright(g[{other}], s.b)"
_PLACE = "cast({x} & (shiftleft(1L, s.b) - 1) AS int)"
_COLLISION = f"""exists(sequence(1, size(g) - 1), j -> shiftright(g[j], s.b) = shiftright(g[j - 1], s.b)
    AND slice(w, {_PLACE.format(x="g[j]")} + 1, 5) <> slice(w, {_PLACE.format(x="g[j - 1]")} + 1, 5))"""
_HASHED_PLACES = f"""transform(filter(g, (x, j) -> (j > 0 AND {_SAME.format(other="greatest(j - 1, 0)")})
    OR (j < size(g) - 1 AND {_SAME.format(other="least(j + 1, size(g) - 1)")})), x -> {_PLACE.format(x="x")})"""
_SORTED = "sort_array(transform(sequence(0, size(w) - 5), i -> struct(slice(w, i + 1, 5) AS k, i AS i)))"
_SORTED_PLACES = f"""element_at(transform(array({_SORTED}), z -> transform(filter(z, (x, j) ->
    (j > 0 AND x.k = z[greatest(j - 1, 0)].k) OR (j < size(z) - 1 AND x.k = z[least(j + 1, size(z) - 1)].k)), x -> x.i)), 1)"""
_PLACES = f"""element_at(transform(array(struct(transform(w, x -> xxhash64(x)) AS h, length(bin(size(w))) AS b)), s ->
    element_at(transform(array({_BY_HASH}), g -> CASE WHEN {_COLLISION} THEN {_SORTED_PLACES} ELSE {_HASHED_PLACES} END), 1)), 1)"""
_REPEATED = f"""CASE WHEN size(w) < 6 THEN 0L ELSE aggregate(sort_array({_PLACES}),
    named_struct('n', 0L, 'e', 0L), (a, p) -> named_struct('n', a.n + p + 5L - greatest(a.e, cast(p AS bigint)), 'e', p + 5L),
    a -> a.n) END"""
_STATISTICS = f"""transform(array({_WORDS}), w -> named_struct(
    'n_words', cast(size(w) AS bigint),
    'word_chars', cast(length(array_join(w, '')) AS bigint),
    'n_repeat_words', {_REPEATED}))"""
_LINES = r"filter(split({text}, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"


class Condition(NamedTuple):
    measure: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.measure] > self.threshold) == self.above

    def sql(self) -> str:
        return f"{MEASURES[self.measure]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of each whole text."""
    name = "coalesce(`" + text.replace("`", "``") + "`, '')"
    others = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in STATISTICS]
    lines = f"element_at(transform(array({_LINES.format(text=name)}), l -> size(l) - size(array_distinct(l))), 1)"
    # A generator evaluates the arrays once and keeps filters on the results from being pushed into them.
    return df.select(
        *others,
        F.expr(f"inline({_STATISTICS.format(text=name)})"),
    ).withColumns(
        {
            "n_symbols": F.expr(f"cast(regexp_count({name}, '[#*$%&|<>]') AS bigint)"),
            "n_dup_lines": F.expr(f"cast({lines} AS bigint)"),
        }
    )


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """Measures and verdict of a bounded sample of labelled documents, taken by a hash of the id."""
    chosen = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("verdict"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    measures = [F.expr(expression).alias(name) for name, expression in MEASURES.items()]
    rows = statistics(texts).where(f"NOT ({BASE_FAILED})").select("doc_id", "verdict", *measures)
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", *MEASURES).limit(sample).collect()
    return [row.asDict() for row in rows]


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Information gained on the bad rows that stay covered."""
    if not after[0]:
        return -math.inf
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _best(rows: list[dict]) -> tuple[float, Condition | None]:
    """The condition of highest gain: one sorted sweep per measure."""
    total = (sum(row["verdict"] == 0 for row in rows), sum(row["verdict"] == 1 for row in rows))
    best: tuple[float, Condition | None] = (1e-9, None)
    for name in MEASURES:
        ordered = sorted(rows, key=lambda row: row[name])
        bad = good = 0
        for row, following in zip(ordered, ordered[1:]):
            bad, good = bad + (row["verdict"] == 0), good + (row["verdict"] == 1)
            if row[name] == following[name]:
                continue
            threshold = (row[name] + following[name]) / 2
            for above, left in ((False, (bad, good)), (True, (total[0] - bad, total[1] - good))):
                if (gain := _gain(total, left)) > best[0]:
                    best = (gain, Condition(name, above, threshold))
    return best


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    return [row for row in rows if all(condition.holds(row) for condition in rule)]


def _precision(rule: Rule, rows: list[dict]) -> float:
    """Share of bad rows among those covered, with one of each kind added."""
    found = _covered(rule, rows)
    return (sum(row["verdict"] == 0 for row in found) + 1) / (len(found) + 2)


def _grown(rows: list[dict]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS and any(row["verdict"] == 1 for row in rows):
        _, condition = _best(rows)
        if condition is None:
            break
        rule, rows = (*rule, condition), [row for row in rows if condition.holds(row)]
    return rule


def learned(rows: list[dict]) -> list[Rule]:
    """An ordered list of conjunctions that reject; every third row prunes what the others grow."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        growing = [row for at, row in enumerate(rows) if at % 3]
        pruning = rows[::3]
        if not any(row["verdict"] == 0 for row in growing):
            break
        rule = _grown(growing)
        shorter = [rule[:size] for size in range(1, len(rule) + 1)]
        if not shorter:
            break
        rule = max(shorter, key=lambda some: _precision(some, pruning))
        found = _covered(rule, rows)
        bad = sum(row["verdict"] == 0 for row in found)
        if bad < SUPPORT or bad < PRECISION * len(found):
            break
        rules.append(rule)
        rows = [row for row in rows if not all(condition.holds(row) for condition in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects: the first one that holds decides."""
    list_of = None
    for rule in rules:
        holds = F.expr(" AND ".join(f"({condition.sql()})" for condition in rule))
        list_of = (F if list_of is None else list_of).when(holds, F.lit(False))
    return F.lit(True) if list_of is None else list_of.otherwise(F.lit(True))


def judged(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add the statistics, base_failed and kept."""
    return statistics(df, text).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )
