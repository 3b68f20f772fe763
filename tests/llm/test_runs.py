"""Periodic runs against every lag of every text, and the cases the operator must take."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import periodic_runs, queries


def all_runs(words):
    """Every maximal stretch of every lag whose smallest period is that lag."""
    found = []
    for q in range(1, len(words) // 3 + 1):
        at = 0
        while at + q < len(words):
            first = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            stretch = words[first : at + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.append((first, len(stretch), q))
            at += at == first
    return sorted(found)


def dropped(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [word for i, word in enumerate(words) if i not in gone]


def made(dice):
    letters = dice.choice([2, 3, 5, 50])
    words = []
    for _ in range(dice.randrange(1, 6)):
        part = [dice.randrange(letters) for _ in range(dice.randrange(1, dice.choice([5, 20, 60])))]
        kind = dice.randrange(5)
        if kind == 1:
            part = part * dice.randrange(1, 4) + [dice.randrange(letters)]
        elif kind == 2:
            part = part + part[: len(part) // 2] + part
        words += part * dice.randrange(2, 6) if kind else part
        words = words[: len(words) - dice.randrange(3)]
    return words


def test_all_runs_are_found():
    dice = random.Random(4)
    count = 0
    for _ in range(600):
        words = made(dice)
        expected = all_runs(words)
        count += len(expected)
        assert periodic_runs.runs(np.array(words, dtype=np.int64)) == expected
    assert count > 400


def test_splitting_leaves_every_run_whole():
    dice = random.Random(9)
    for _ in range(200):
        words = [dice.randrange(40) for _ in range(50)] + made(dice) + [dice.randrange(40) for _ in range(50)]
        parts = periodic_runs.segments(np.array(words))
        assert all(end - at >= 24 and min(words[at:end].count(x) for x in words[at:end]) >= 3 for at, end in parts)
        for start, length, _ in all_runs(words):
            assert any(at <= start and start + length <= end for at, end in parts)


def test_prose_falls_apart():
    dice = random.Random(2)
    words = [dice.choice(["the", "of"]) if dice.random() < 0.3 else f"w{dice.randrange(4000)}" for _ in range(5000)]
    assert periodic_runs.segments(periodic_runs.numbered(words)) == []


def test_long_periods_and_long_texts():
    dice = random.Random(6)
    part = [dice.randrange(300) for _ in range(7001)]
    assert periodic_runs.runs(np.array([1000] + part * 9)) == [(1, 63009, 7001)]
    assert periodic_runs.runs(np.zeros(400_000, dtype=np.int64)) == [(0, 400_000, 1)]


@pytest.fixture(scope="module")
def found(spark, edge):
    return queries.op13_periodic_runs(spark, edge).collect()


def test_query_against_every_lag(found, texts):
    assert len(found) == len(texts)
    loops = 0
    for row in found:
        plain = texts[row["doc_id"]].encode().split()
        words = periodic_runs.looped(row["doc_id"], plain)
        if len(words) > 5000:
            continue
        loops += words != plain
        expected = all_runs(words)
        assert row["n_runs"] == len(expected)
        if expected:
            best = min(expected, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert row["start"] is row["length"] is row["period"] is row["exponent_milli"] is None
        lines = "".join("{},{},{}\n".format(a, n, q) for a, n, q in expected)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(dropped(words, expected))).hexdigest()
    assert loops > 2


def test_empty_table(spark, empty):
    frame = queries.op13_periodic_runs(spark, empty)
    assert frame.collect() == [] and dict(frame.dtypes)["length"] == "bigint"


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b " * 20, 7), (None, "a b " * 20, 7), (None, None, 7), (5, "", 7), (5, "x " * 40 + "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, start int")
    result = periodic_runs.periodic_runs(docs.withColumn("periods", F.lit("z"))).collect()
    shown = sorted(((r["doc_id"] or 0, r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) for r in result), key=str)
    assert shown == [
        (0, 0, None, None, None, ""), (0, 1, 0, 40, 2, "a b"), (0, 1, 0, 40, 2, "a b"),
        (5, 0, None, None, None, ""), (5, 1, 0, 40, 1, "x y"),
    ]
