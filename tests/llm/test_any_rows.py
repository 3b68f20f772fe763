"""Operators on rows without an id, repeated ids and rows, columns of the outputs' names; verdicts against plain evaluation."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stayline.llm import byte_bpe, elias_fano, language_id, packing, quality_rules, token_counts
from tests.llm.conftest import sentence
from tests.llm.test_operators import least_tokens, ranks

CLASHING = (
    "n_tokens", "n_pretokens", "ids", "decoded", "score", "lang_pred", "kept", "base_failed", "n_words", "piece", "start", "length",
    "sequence_id", "offset", "row", "document", "place", "tie", "fill", "n",
)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(21)
    texts = [sentence(dice, dice.choice([1, 8, 40, 300])) for _ in range(25)]
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[0]), (None, None), (None, ""), (3, texts[3]), (3, texts[3]), (3, "another of id three")]
    return rows + [(4, None), (4, "x <|endoftext|> y"), (5, sentence(dice, 25_000))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names of all outputs; ``at`` tells the row."""
    made = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "at long, doc_id long, text string")
    for name in CLASHING:
        made = made.withColumn(name, F.lit("clash"))
    return made.repartition(3).cache()


def by_row(frame, rows):
    found = {row["at"]: row for row in frame.collect()}
    assert set(found) == set(range(len(rows)))
    assert all(found[i]["doc_id"] == rows[i][0] for i in found)
    return [found[i] for i in range(len(rows))]


def test_token_counts(docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.scores_of(path)
    worst = min(scores.values()) - 10_000
    known = {}
    for (_, text), row in zip(rows, by_row(token_counts.token_counts(docs, path), rows)):
        words = Counter(re.findall("\n| ?[^ \n]+| ", " " + text) if text else [])
        for word in words.keys() - known.keys():
            known[word] = least_tokens(word, scores, worst)
        assert row["n_tokens"] == sum(known[word] * times for word, times in words.items())
        assert row["n_pretokens"] == words.total() and row["kept"] == "clash"


def test_byte_bpe(docs, rows):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    decoded = byte_bpe.decode(byte_bpe.encode(docs, *vocabulary), *vocabulary)
    for (_, text), row in zip(rows, by_row(decoded, rows)):
        assert list(row["ids"]) == library.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode() and row["piece"] == "clash"


def plain_statistics(text):
    words = text.split()  # the texts here have no other white space
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    lines = [line for line in text.split("\n") if line.split()]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}),
    }


def test_quality_rules_of_any_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    assert len(quality_rules.labelled(docs, labels)) > 5
    for (_, text), row in zip(rows, by_row(quality_rules.judged(docs, []), rows)):
        assert {name: row[name] for name in quality_rules.STATISTICS} == plain_statistics(text or "")
        assert row["kept"] == (not row["base_failed"]) and row["score"] == "clash"


def test_the_list_decides_what_is_kept(spark):
    """On whole tables: a document stays unless the base rule or a rule of the list holds, evaluated here."""
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.learned(quality_rules.labelled(docs, spark.read.parquet(f"{where}/labels.parquet")))
    rules += [(quality_rules.Condition("word_length", True, 5.5), quality_rules.Condition("words", False, 150.0))]
    measures = [F.expr(sql).alias(f"m_{name}") for name, sql in quality_rules.MEASURES.items()]
    found = quality_rules.judged(docs, rules).select("*", *measures).collect()
    rejected = 0
    for row in found:
        plain = plain_statistics(row["text"]) if len(row["text"]) < 3000 else {name: row[name] for name in quality_rules.STATISTICS}
        assert {name: row[name] for name in quality_rules.STATISTICS} == plain
        measured = {name: row[f"m_{name}"] for name in quality_rules.MEASURES}
        failed = plain["n_words"] < 10 or 100 * plain["n_repeat_words"] > 20 * plain["n_words"]
        held = not failed and any(all(condition.holds(measured) for condition in rule) for rule in rules)
        rejected += held
        assert row["kept"] == (not failed and not held)
    assert len(rules) > 1 and 0 < rejected < len(found) / 2


def by_convolution(net, text):
    """Language and score of a text: every filter at every place of every window, one product at a time."""
    data = text.encode()
    windows = [data[i : i + language_id.WINDOW] for i in range(0, len(data), language_id.WINDOW)]
    total = np.zeros(len(net.languages))
    for window in windows:
        codes = list(window) + [language_id.PAD] * (language_id.WINDOW - len(window))
        hidden = []
        for width, kernel in net.filters.items():
            places = [np.concatenate([net.embedding[c] for c in codes[i : i + width]]) @ kernel for i in range(len(codes) - width + 1)]
            hidden.append(np.max(places, axis=0))
        values = np.maximum(np.concatenate(hidden) + net.shift, 0) @ net.weights + net.bias
        shares = np.exp(values - values.max())
        total += len(window) * shares / shares.sum()
    total /= len(data)
    return net.languages[int(total.argmax())], float(total.max())


@pytest.fixture(scope="module")
def network(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language_id.fit(table.select("doc_id", "text", "lang"), 300)


def test_windows_against_plain_convolution(spark, network):
    texts = [row.text[:700] for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(12).collect()]
    texts += ["a", "é" * 129, texts[0][:256], texts[0][:257]]
    names, scores = network.predict(texts)
    for text, name, score in zip(texts, names, scores):
        expected = by_convolution(network, text)
        assert name == expected[0] and score == pytest.approx(expected[1], abs=1e-4)


def test_language_of_any_rows(docs, rows, network):
    names, scores = network.predict([text for _, text in rows])
    for name, score, row in zip(names, scores, by_row(language_id.identified(docs, network), rows)):
        assert (row["lang_pred"], row["score"], row["kept"]) == (name, pytest.approx(score, abs=1e-6), "clash")


def test_packing_of_any_rows(docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 512, 0)
    found = packing.pack(pieces, 512).collect()
    ids, fill = {}, Counter()
    for row in sorted(found, key=lambda r: (r["at"], r["piece"])):
        ids.setdefault(row["at"], []).extend(np.frombuffer(row["ids"], "<u4").tolist())
        fill[row["sequence_id"]] += row["length"]
        assert row["score"] == "clash"
    for i, (_, text) in enumerate(rows):
        assert ids[i] == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    assert max(fill.values()) <= 512


def test_archive_of_any_rows(spark, docs, rows, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    elias_fano.write(docs, str(tmp_path / "a"), public_tokenizers.path("word_bpe_49k.json"), 2)
    found = sorted(elias_fano.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    order = [row["doc_id"] for row in found]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    shown = Counter((row["doc_id"], bytes(row["ids"])) for row in found)
    expected = Counter(
        (name, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for name, text in rows
    )
    assert shown == expected
    assert [row["start"] for row in found] == np.cumsum([0, *(row["n_tokens"] for row in found[:-1])]).tolist()


def test_pipeline_of_rows_without_ids_and_repeated_rows(spark, tmp_path):
    """Nulls and repeats go through the whole chain; copies leave one row, distinct texts of one id all stay."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = [row.asDict() for row in table.where("lang = 'en' AND n_chars BETWEEN 400 AND 3000").orderBy("doc_id").limit(150).collect()]
    some[1]["doc_id"] = some[2]["doc_id"] = None
    some[3]["doc_id"] = some[4]["doc_id"]
    extra = [dict(some[5]), dict(some[5]), {**some[6], "doc_id": None}, {**some[7], "text": None}, {**some[8], "doc_id": 10**9, "text": ""}]
    where = str(tmp_path)
    spark.createDataFrame(some + extra, table.schema).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{where}/labels.parquet")
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, where).collect(), docs.schema)
        kept[name] = Counter((row.doc_id, row.text) for row in docs.collect())
    given = Counter((row["doc_id"], row["text"]) for row in some + extra)
    # Rules and language judge each row alone: equal rows share their fate.
    for name in ("quality_rules", "language_id"):
        assert all(kept[name][row] == given[row] for row in kept[name]) and len(kept[name]) > 100
    assert all(times == 1 for times in kept["jaccard_join"].values())
    texts = [text for _, text in kept["jaccard_join"]]
    assert len(set(texts)) == len(texts)
    assert kept["suffix_dedup"].total() == kept["jaccard_join"].total()
    packed = corpus_pipeline.run(spark, where).collect()
    ids = Counter(name for name, _ in kept["suffix_dedup"].elements())
    assert Counter(row.doc_id for row in packed if row.piece == 0) == ids
