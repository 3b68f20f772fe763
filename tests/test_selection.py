"""Rows at ranks against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import model, ranking, selection, targeting
from stayline.sources import scratch

ORDER = selection.Order(text="name", value="score", stratum="team")


def in_order(row):
    team, score, name = row
    kind = 4 if score is None else 0 if math.isnan(score) else 1 if score == -math.inf else 3 if score == math.inf else 2
    return (kind, score + 0.0 if kind == 2 else 0, b"" if name is None else b"x" + name.encode())


def mixed_rows(dice, count):
    """A hot score, a hot key, near scores, extremes, texts that begin alike or hold each other."""
    near = 0.1
    scores = [0.25] * 6 + [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 1.7e308, -1.7e308, 5e-324, -3.0, near, math.nextafter(near, 1)]
    names = ["hot"] * 5 + [None, "", "a", "a\0", "ab", "aé", "é", "prefix", "prefix and more", "日本"]
    for _ in range(count):
        score = dice.choice(scores) if dice.random() < 0.6 else dice.uniform(-2, 2)
        name = dice.choice(names) if dice.random() < 0.6 else f"prefix and {dice.randrange(10**6)}"
        yield dice.choice("xxxy"), score, name


@pytest.fixture(scope="module", params=[0, 1, 7, 1500])
def rows(request, spark):
    data = list(mixed_rows(random.Random(request.param), request.param))
    frame = spark.createDataFrame(data, "team string, score double, name string").repartition(6)
    return data, scratch.table(frame, "keys")


@pytest.mark.parametrize("sizes", [(4096, 3, 4096), (4, 1, 0), (7, 2, 20)])
def test_cuts_are_the_sorted_rows(rows, monkeypatch, sizes):
    for name, size in zip(("INTERVALS", "LETTERS", "FEW"), sizes):
        monkeypatch.setattr(selection, name, size)
    data, frame = rows
    tenths = lambda size: [1 + (size - 1) * j // 10 for j in range(1, 10)]
    found = selection.cuts(frame, ORDER, tenths)
    for team in "xy":
        ordered = sorted((row for row in data if row[0] == team), key=in_order)
        cuts = [cut for cut in found if cut.stratum == team]
        assert [cut.rank for cut in cuts] == (tenths(len(ordered)) if ordered else [])
        for cut in cuts:
            kind, score, name = in_order(ordered[cut.rank - 1])
            assert (cut.kind, cut.value) == (kind, score)
            assert cut.text == ("1" + name[1:].hex().upper() if name else "0")
            same = [i for i, row in enumerate(ordered, 1) if in_order(row) == (kind, score, name)]
            assert (cut.equal, cut.taken) == (len(same), cut.rank - same[0] + 1)


def test_rows_before_and_after_cuts(rows):
    """Each cut leaves as many rows behind it as its rank says, also through rows of one key."""
    data, frame = rows
    quarters = lambda size: [size * j // 4 for j in (1, 2, 3) if size * j // 4]
    found = selection.cuts(frame, ORDER, quarters)
    placed = selection.with_cuts_before(frame, ORDER, found, "after").collect()
    assert sorted(map(repr, ((r.team, r.score, r.name) for r in placed))) == sorted(map(repr, data))
    for team in "xy":
        inside = sorted((in_order((r.team, r.score, r.name)), r.after) for r in placed if r.team == team)
        assert [after for _, after in inside] == sorted(after for _, after in inside)
        for cut in (cut for cut in found if cut.stratum == team):
            upto = len([c for c in found if c.stratum == team and c.rank < cut.rank])
            assert sum(after <= upto for _, after in inside) == cut.rank


def plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("operator", [ranking.stratified_split, targeting.with_deciles])
def test_nothing_is_sorted_moved_or_written(spark, monkeypatch, operator):
    """Neither a range exchange nor any other, and no written table, for accounts with an id of their own."""
    made = []
    real = scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: made.append(df.columns) or real(df, name))
    accounts = spark.range(3000).selectExpr(
        "CAST(id AS STRING) AS customer_id", "CAST(id % 3 = 0 AS INT) AS is_churned", "(id * 7919 % 3001) / 3001D AS churn_probability", "'x' AS wide"
    )
    found = operator(accounts)
    assert made == [] and "Exchange" not in plan(found) and "Sort" not in plan(found)
    assert found.count() == 3000


def test_no_pass_is_a_range_exchange(spark, monkeypatch):
    plans = []
    real = selection.grouped
    monkeypatch.setattr(selection, "grouped", lambda *given: plans.append(plan(found := real(*given))) or found)
    monkeypatch.setattr(selection, "FEW", 2)
    accounts = spark.range(5000).selectExpr("CAST(id AS STRING) AS customer_id", "CAST(id % 2 AS INT) AS is_churned", "0.5D AS churn_probability")
    ranking.stratified_split(accounts)
    targeting.with_deciles(accounts)
    assert len(plans) > 4 and not any("rangepartitioning" in text for text in plans)


def test_a_copied_account_at_the_border_is_torn_by_number_only(spark):
    """All accounts are copies of one: the split takes 30 % of them, and only then rows are written."""
    copies = spark.range(0, 1000, 1, 7).selectExpr("'same' AS customer_id", "0 AS is_churned", "0.5D AS churn_probability", "id")
    split = ranking.stratified_split(copies).groupBy("split").count().collect()
    assert {row["split"]: row["count"] for row in split} == {"test": 300, "train": 700}
    tenths = targeting.with_deciles(copies).groupBy("decile").count().collect()
    assert sorted((row["decile"], row["count"]) for row in tenths) == [(1, 100), *((j, 100) for j in range(2, 11))]


def test_accounts_without_a_label_are_trained_on(spark):
    accounts = spark.createDataFrame([("a", None), ("b", 1), ("c", 1), ("d", 1)], "customer_id string, is_churned int")
    found = {row["customer_id"]: row["split"] for row in model.split_accounts(accounts).collect()}
    assert found["a"] == "train" and list(found.values()).count("test") == 1
    assert model.split_accounts(accounts.where(F.lit(False))).collect() == []
