"""Collocations against plain counting, and the automata under them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import collocations, phrase_machines, queries
from stayline.llm.phrase_machines import Machine


def by_counting(rows, least=30, top=2000):
    """Of (lang, text): rows lang, rank, phrase, a, l, r, n, score."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    found = []
    for lang, f in counts.items():
        n = sum(a for phrase, a in f.items() if len(phrase) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {
            p[i : i + size]
            for p, longer in candidates.items()
            for size in range(2, len(p))
            for i in range(len(p) - size + 1)
            if 100 * longer >= 80 * f[p[i : i + size]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in held:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(found)


def shown(frame):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert frame.columns == names
    return sorted(tuple(row) for row in frame.collect())


def prose(dice, count):
    """Words of few letters in many combinations, set phrases, breaks of every kind, hot pairs."""
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "don't", "W1", "日本"]
    for i in range(count):
        parts = []
        for _ in range(dice.randrange(60)):
            parts.append(dice.choice(["in spite Of", "hot pair", "once upon a time", "a a a a a", dice.choice(words), dice.choice(words)]))
            if dice.random() < 0.2:
                parts.append(dice.choice(".,;:!?\n\x0b\x0c\r"))
        yield dice.choice(["en", "en", "de", None]), dice.choice([" ", "\t", "  "]).join(parts)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    dice = random.Random(12)
    rows = [*prose(dice, 250), ("en", None), (None, ""), ("fr", " \t"), ("es", None), ("en", "hot pair " * 4000), ("en", "x")]
    where = str(tmp_path_factory.mktemp("prose") / "documents.parquet")
    spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, lang string, text string").repartition(5).write.parquet(where)
    return rows, spark.read.parquet(where)


def test_against_counting(small):
    rows, docs = small
    expected = by_counting(rows)
    assert len(expected) > 60 and {len(row[2].split()) for row in expected} == {2, 3, 4}
    assert shown(collocations.collocations(docs)) == expected


def test_many_shards_and_ranges_and_a_full_sieve(small, monkeypatch):
    """Shards of few words, ranges of few bytes, a sieve that lets nearly everything through: the same rows."""
    monkeypatch.setattr(collocations, "SHARD", 700)
    monkeypatch.setattr(collocations, "RANGE", 20_000)
    monkeypatch.setattr(collocations, "SIEVE_BITS", 64)
    rows, docs = small
    assert shown(collocations.collocations(docs)) == by_counting(rows)


def weak_labels(monkeypatch):
    """Under seed 0 all words of one length share a label."""
    real = collocations.xxhash.xxh3_64_intdigest

    class Weak:
        @staticmethod
        def xxh3_64_intdigest(data, seed=0):
            return real(data, seed) if seed or isinstance(data, str) else 2 * len(data)

    monkeypatch.setattr(collocations, "xxhash", Weak)


def united(seed, *texts):
    """The one range of words of some shards."""
    shards = []
    for text in texts:
        batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
        shards += collocations._shards(1, 1, seed, None, None)(iter([batch]))
    return collocations._united(pa.Table.from_batches(shards)).to_pylist()[0]


@pytest.mark.parametrize("texts", [("ab cd",), ("ab ab", "cd")])
def test_words_that_share_a_label_are_noticed(monkeypatch, texts):
    weak_labels(monkeypatch)
    assert united(0, *texts)["clash"] and not united(1, *texts)["clash"] and not united(0, "ab abc", "ab")["clash"]


def test_another_seed_is_taken_after_a_clash(small, monkeypatch):
    rows, docs = small
    real, seeds = collocations.machines_of, []

    def clashing(docs, depth, size, seed, *sieves):
        seeds.append(seed)
        return real(docs, depth, size, seed, *sieves).withColumn("clash", F.lit(seed < 2))

    monkeypatch.setattr(collocations, "machines_of", clashing)
    assert shown(collocations.collocations(docs)) == by_counting(rows)
    assert seeds == [0, 1, 2, 2, 2]


def test_long_texts_are_cut_at_breaks_only(monkeypatch):
    text = ("one two, three\tfour " * 50 + "and " * 400 + "; end").encode()
    whole = collocations._Words()
    whole.add(text)
    expected = whole.done(0)
    monkeypatch.setattr(collocations, "SLAB", 30)
    cut = collocations._Words()
    cut.add(text)
    assert len(cut.ids) > 10
    word, piece, labels, words = cut.done(0)
    assert words == expected[3] and np.array_equal(labels, expected[2]) and np.array_equal(word, expected[0])
    assert np.array_equal(np.diff(piece) > 0, np.diff(expected[1]) > 0)


def test_top_cuts_through_ties(small):
    rows, docs = small
    assert shown(collocations.collocations(docs, 7)) == by_counting(rows, top=7)


def test_query_on_whole_tables(spark):
    where = "/root/testdata/sf0.01"
    rows = [(row.lang, row.text) for row in spark.read.parquet(f"{where}/documents.parquet").collect()]
    assert shown(queries.op12_collocations(spark, where)) == by_counting(rows)


def test_edge_and_empty_tables(spark, edge, empty):
    rows = [(row.lang, row.text) for row in spark.read.parquet(f"{edge}/documents.parquet").collect()]
    assert shown(queries.op12_collocations(spark, edge)) == by_counting(rows)
    assert shown(queries.op12_collocations(spark, empty)) == []


def test_clashing_columns_and_repeated_rows(spark):
    rows = [("en", "to be or not to be")] * 31
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], "lang string, text string, rank int, phrase string")
    assert shown(collocations.collocations(docs.withColumn("machine", F.lit(1)))) == by_counting(rows)


def test_machines_keep_add_and_find_counts():
    dice = np.random.default_rng(1)
    for _ in range(100):
        depth = int(dice.integers(1, 5))
        parts = []
        total = Counter()
        for _ in range(int(dice.integers(1, 4))):
            rows = {}
            for _ in range(dice.integers(1, 60)):
                size = int(dice.integers(1, depth + 1))
                rows[(*dice.integers(1, 5, size).tolist(), *[0] * (depth - size))] = int(dice.integers(1, 4))
            total.update(rows)
            ordered = sorted(rows)
            machine = phrase_machines.built(np.array(ordered, np.uint64), np.array([rows[p] for p in ordered]))
            parts.append(Machine.unpacked(machine.packed()))
            phrases, counts = parts[-1].phrases()
            assert dict(zip(map(tuple, phrases.tolist()), counts.tolist())) == rows
        phrases, counts, everything = phrase_machines.added(parts, 3)
        assert everything == sum(total.values())
        assert list(zip(map(tuple, phrases.tolist()), counts.tolist())) == sorted((p, a) for p, a in total.items() if a >= 3)
        asked = dice.integers(0, 6, (60, depth)).astype(np.uint64)
        asked = np.where(np.logical_or.accumulate(asked == 0, axis=1), 0, asked).astype(np.uint64)
        if len(phrases):
            found = phrase_machines.built(phrases, counts).counts(asked).tolist()
            assert found == [total[tuple(p)] if total[tuple(p)] >= 3 else 0 for p in asked.tolist()]


def test_equal_tails_are_one_state():
    phrases = np.array([[first, second, third] for first in range(1, 9) for second in (3, 4) for third in (5, 6)], np.uint64)
    machine = phrase_machines.built(phrases, np.ones(len(phrases), np.int64))
    assert [len(layer.label) for layer in machine.layers] == [8, 2, 2]
