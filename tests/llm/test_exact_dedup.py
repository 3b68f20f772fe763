"""Exact copies against a dictionary of texts, with forced collisions and full sieves."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayline.llm import exact_dedup, queries


def expected(rows):
    """Of (id, text): id, id that stays, group size, digest; and how many rows stay."""
    same = defaultdict(list)
    for name, text in rows:
        same[text or ""].append(name)
    shown = []
    for text, names in same.items():
        best = max((name for name in names if name is not None), default=None)
        shown += [(name, best, len(names), hashlib.sha256(text.encode()).hexdigest()) for name in names]
    return sorted(shown, key=repr), len(same)


def check(frame, rows):
    found = frame.collect()
    every, stay = expected(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr) == every
    kept = [r for r in found if r["kept"]]
    assert len(kept) == stay == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def copies(dice, count=400):
    """A third one text, some pairs, repeated rows, null ids, null and empty texts."""
    rows = [(i, "hot text") if dice.random() < 0.33 else (i, f"text {dice.randrange(300)}") for i in range(count)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "hot text"), (None, "no id"), (None, "no id"), (None, None)]
    return rows + [(1000, None), (1001, ""), (1002, "é" * 40_000), (1003, "é" * 40_000), (-7, " "), (-8, "hot text ")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = copies(random.Random(8))
    where = str(tmp_path_factory.mktemp("copies") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(where)
    return rows, spark.read.parquet(where)


@pytest.mark.parametrize("low", [0, 1 << 40])
def test_codes_round_trip(low):
    dice = random.Random(1)
    for count, span in [(1, 1), (1, 1 << 30), (7, 7), (500, 500), (500, 1 << 20), (3000, 1 << 34)]:
        values = np.array(sorted(dice.sample(range(span), count)), dtype=np.int64) + low
        width, quotients, rests = exact_dedup.coded(values, low)
        assert np.array_equal(exact_dedup.decoded(count, low, width, quotients, rests), values)
        # Near the entropy of a set: two bits and the logarithm of the mean gap.
        if count > 100:
            assert 8 * (len(quotients) + len(rests)) <= count * (np.log2(span / count) + 2.5) + 16


def test_rows_against_a_dictionary(table):
    rows, docs = table
    check(exact_dedup.groups(docs), rows)


def test_texts_that_share_a_fingerprint_part(table, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda text: F.xxhash64(F.length(text)))
    rows, docs = table
    check(exact_dedup.groups(docs), rows)


def test_more_suspects_than_the_sieve_holds(table, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SIEVE_BITS", 64)
    rows, docs = table
    check(exact_dedup.groups(docs), rows)
    assert exact_dedup.distinct_texts(docs).count() == expected(rows)[1]


def test_many_slices_and_owners(table, monkeypatch):
    """Codes of a few bits, senders of ten rows, owners of twenty: the answers still find every copy."""
    monkeypatch.setattr(exact_dedup, "SENT", 10)
    monkeypatch.setattr(exact_dedup, "OWNED", 20)
    rows, docs = table
    check(exact_dedup.groups(docs.repartition(11)), rows)


def test_exchange_finds_exactly_what_repeats(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNED", 50)
    dice = random.Random(3)
    codes = [dice.randrange(1 << 16) for _ in range(900)] + [0, (1 << 16) - 1] + [77] * 300
    codes += dice.sample(codes, 40)
    frame = spark.createDataFrame([(code,) for code in codes], "code long").repartition(9)
    found = exact_dedup.exchanged(frame, 16, len(codes)).collect()
    assert sorted(row.code for row in found) == sorted({code for code in codes if codes.count(code) > 1})


def test_only_suspects_are_shuffled(table):
    _, docs = table
    prints = exact_dedup._with_print(docs, "text")
    inside, outside = exact_dedup._Suspects(prints.select("print")).divided(prints)
    assert inside.count() + outside.count() == docs.count()
    assert inside.select("content").distinct().count() < 1.2 * len({t for n, t in expected_repeats(docs)})


def expected_repeats(docs):
    rows = [(row.doc_id, row.text or "") for row in docs.collect()]
    texts = [text for _, text in rows]
    return [(name, text) for name, text in rows if texts.count(text) > 1]


def test_distinct_texts_keep_all_columns(table):
    rows, docs = table
    wide = docs.withColumn("print", F.lit("p")).withColumn("content", F.lit(1)).withColumn("document", F.col("doc_id"))
    found = exact_dedup.distinct_texts(wide)
    assert found.columns == wide.columns
    every, stay = expected(rows)
    shown = found.collect()
    assert len(shown) == stay
    best = {digest: keep for _, keep, _, digest in every}
    for row in shown:
        assert row["doc_id"] == best[hashlib.sha256((row["text"] or "").encode()).hexdigest()] == row["document"]


def test_clashing_columns(spark):
    rows = [(1, "a", 9, "x"), (2, "a", 9, "x"), (3, "b", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, keep_id int, print string")
    check(exact_dedup.groups(docs.withColumn("row", F.lit(0)).withColumn("kept", F.lit("no"))), [row[:2] for row in rows])


def test_edge_and_empty_tables(spark, edge, empty):
    rows = [(row.doc_id, row.text) for row in spark.read.parquet(f"{edge}/documents.parquet").collect()]
    check(queries.op11_exact_dedup(spark, edge), rows)
    assert queries.op11_exact_dedup(spark, empty).collect() == []
    assert exact_dedup.distinct_texts(spark.read.parquet(f"{empty}/documents.parquet")).collect() == []
