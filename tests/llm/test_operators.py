"""Operators against brute force, other libraries and exact round trips."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from stayline.llm import byte_bpe, elias_fano, exact_topk, language_id, library_tokens, packing, quality_rules, queries, token_counts, warc


def result(spark, name, where):
    return [row.asDict() for row in queries.QUERIES[name](spark, where).collect()]


def by_id(rows, key="doc_id"):
    found = {row[key]: row for row in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert result(spark, name, empty) == []


# 1: token counts


def least_tokens(word, scores, worst):
    """Best (score, -tokens) over all splits, by recursion from the left."""
    best = {len(word): (0, 0)}
    for start in range(len(word) - 1, -1, -1):
        ways = []
        for end in range(start + 1, len(word) + 1):
            if word[start:end] in scores:
                ways.append((scores[word[start:end]] + best[end][0], best[end][1] - 1))
        if word[start] not in scores:
            size = len(word[start].encode())
            ways.append((size * worst + best[start + 1][0], best[start + 1][1] - size))
        best[start] = max(ways)
    return -best[0][1]


def test_token_counts(spark, edge, texts):
    scores = token_counts.scores_of(public_tokenizers.path("piece_bpe_32k.model"))
    worst = min(scores.values()) - 10_000
    found = by_id(result(spark, "op1_token_counts", edge))
    assert set(found) == set(texts)
    known = {}
    for name, text in texts.items():
        if len(text) > 10_000:
            continue
        words = re.findall("\n| ?[^ \n]+| ", " " + text) if text else []
        for word in set(words) - set(known):
            known[word] = least_tokens(word, scores, worst)
        assert (found[name]["n_tokens"], found[name]["n_pretokens"]) == (sum(known[w] for w in words), len(words))


def test_trie_starts_anew(monkeypatch):
    scores = token_counts.scores_of(public_tokenizers.path("piece_bpe_32k.model"))
    words = [" word", " words", " wording", " other", " ot", " word"]
    whole = token_counts.Trie(scores)
    expected = [whole[word] for word in words]
    assert len(whole.forward) < 1 + sum(map(len, words))  # prefixes are shared
    monkeypatch.setattr(token_counts, "NODES", 3)
    small = token_counts.Trie(scores)
    assert [small[word] for word in words] == expected


# 3: byte-level BPE


def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_byte_bpe(spark, edge, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    found = by_id(result(spark, "op3_byte_bpe", edge))
    assert set(found) == set(texts)
    for name, text in texts.items():
        ids = library.encode_ordinary(text)
        assert found[name]["n_tokens"] == len(ids), text[:50]
        assert found[name]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text[:50]
        assert found[name]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_replay_with_ranks_out_of_order(tmp_path):
    """A merge that makes a pair of lower rank: the per-word rule must win."""
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bc", b"ca", b"aa", b"aaa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    replay = byte_bpe.Replay(str(path), public_tokenizers.PATTERN)
    words = [b"abcabcaaaa", b"aaaaa", b"bcabc", b"", b"a"]
    assert replay.replay(words) == [replay.one_word(word) for word in words]


def test_byte_bpe_holds_little_of_a_batch(monkeypatch):
    """What a worker remembers, merges and hands on at a time is bounded, whatever the batch; ids and bytes stay the same."""
    import random

    for name, most in {"MEMO": 300, "IDS": 4000, "PAIRS": 500, "TEXT": 2000, "CORPUS": 500, "DECODED": 100}.items():
        monkeypatch.setattr(byte_bpe, name, most)
    dice = random.Random(3)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000aBéßà日本1!.,😀") + [" ", " ", "\n", "'s", "don't", "...", "the", "ation"]
    texts = ["".join(dice.choice(letters) for _ in range(dice.randrange(40))) for _ in range(3000)]
    texts += [None, "", " ", "y" * 5000, "日本" * 3000, None, *("".join(dice.choices("abcdefgh", k=900)) for _ in range(20)), "end"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    replay = byte_bpe.Replay(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, remembered = [], []
    for part in replay.encode_batch(pa.array([None, *texts], pa.string()).slice(1)):
        assert len(part) == 1 or sum(map(len, part.to_pylist())) <= 2000
        remembered.append((len(replay.memo), len(replay.ids)))
        ids += part.to_pylist()
    assert ids == [library.encode_ordinary(text or "") for text in texts]
    assert max(n for n, _ in remembered) <= 300 + 2000 and max(n for _, n in remembered) <= 4000 + 6 * 3000
    decoded = list(replay.decode_batch(pa.array([[0], None, *ids], pa.list_(pa.int32())).slice(1)))
    assert max(map(len, decoded)) < 500
    assert [x for part in decoded for x in part.to_pylist()] == [b"", *((text or "").encode() for text in texts)]
    for nothing in (replay.encode_batch(pa.array([], pa.string())), replay.decode_batch(pa.array([], pa.list_(pa.int32())))):
        assert [len(part) for part in nothing] == [0]


def test_byte_bpe_of_texts_longer_than_a_slice(spark):
    texts = [None, "a", "some words, " * 300_000, "", None, "b c", "z" * 100_000, "é. " * 50_000, "d"]
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = sorted(byte_bpe.decode(byte_bpe.encode(docs, *vocabulary), *vocabulary).collect())
    assert [row["doc_id"] for row in rows] == list(range(len(texts)))
    for text, row in zip(texts, rows):
        assert list(row["ids"]) == library.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()


# 4: top k


def test_top_k(spark, edge):
    rows = []
    for row in spark.read.parquet(f"{edge}/embeddings.parquet").collect():
        vector = row["embedding"]
        if row["vec_id"] is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            rows.append((row["vec_id"], [math.floor(1024 * x) for x in vector]))
    expected = []
    for query, left in rows:
        if query % 100 == 0:
            scored = [
                (-sum(a * b for a, b in zip(left, right)), name)
                for name, right in rows
                if name != query and len(left) == len(right)
            ]
            expected += [(query, rank, name, -score) for rank, (score, name) in enumerate(sorted(scored)[:10], 1)]
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result(spark, "op4_exact_topk", edge)]
    assert sorted(found) == sorted(expected)
    assert any(a[:1] == b[:1] and a[3] == b[3] for a, b in zip(sorted(expected), sorted(expected)[1:]))


def test_top_k_when_scores_lie_close_above_a_part(spark):
    """Intervals that are no whole number of parts wide must not count the scores above them again."""
    dice = np.random.default_rng(0)
    vectors = dice.integers(-1000, 1000, (400, 2)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<long>").repartition(3)
    expected = []
    for query in range(0, 400, 10):
        scored = sorted(
            (-sum(a * b for a, b in zip(vectors[query], right)), name) for name, right in enumerate(vectors) if name != query
        )
        expected += [(query, rank, name, -score) for rank, (score, name) in enumerate(scored[:10], 1)]
    found = exact_topk.top_k(rows, rows.where("id % 10 = 0"), 10).collect()
    assert sorted(tuple(r) for r in found) == expected


# 5: quality rules


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if w in twice for k in range(5)}),
    }


def test_statistics(spark, edge, texts):
    found = by_id(result(spark, "op5_quality_rules", edge))
    assert set(found) == set(texts)
    for name, text in texts.items():
        if len(text) < 20_000:
            assert {k: found[name][k] for k in quality_rules.STATISTICS} == statistics(text), text[:60]
        failed = found[name]["n_words"] < 10 or 100 * found[name]["n_repeat_words"] > 20 * found[name]["n_words"]
        assert found[name]["base_failed"] == failed
        assert not (failed and found[name]["kept"])


def test_windows_of_equal_hash_are_compared_word_by_word(spark, monkeypatch):
    monkeypatch.setattr(
        quality_rules, "_STATISTICS", re.sub(r"xxhash64\(s\.h.*?\)", "1L", quality_rules._STATISTICS, flags=re.S)
    )
    texts = ["a b c d e f g a b c d e f h", "a b c d e f g h i j"]
    df = quality_rules.statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [r["n_repeat_words"] for r in df.collect()] == [statistics(t)["n_repeat_words"] for t in texts] == [12, 0]


def test_learned_rules_find_the_threshold():
    rows = [
        {"verdict": int(i % 5 > 0), "words": 100.0, "word_length": 5.0, "symbols": 0.2 if i % 5 == 0 else 0.01 * (i % 3),
         "repeated": 0.0, "duplicate_lines": 0.0}
        for i in range(300)
    ]
    (rule,) = quality_rules.learned(rows)
    assert rule == (quality_rules.Condition("symbols", True, 0.11),)
    assert quality_rules.learned([]) == quality_rules.learned(rows[1:5]) == []


# 6: WARC


def test_warc(spark, edge):
    pages = {row["page_id"]: row["html"] or "" for row in spark.read.parquet(f"{edge}/pages.parquet").collect()}
    largest = {}
    for name, html in pages.items():
        largest[html] = max(name, largest.get(html, name))
    found = by_id(result(spark, "op6_warc", edge), "page_id")
    assert set(found) == set(pages)
    for name, html in pages.items():
        data, response = html.encode(), largest[html]
        assert found[name] == {
            "page_id": name,
            "payload_bytes": len(data),
            "payload_digest": base64.b32encode(hashlib.sha1(data).digest()).decode(),
            "record_type": "response" if name == response else "revisit",
            "refers_to": None if name == response else response,
        }


def test_warc_round_trip_over_segments(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    pages = spark.createDataFrame([(1, "u", "é" * 100_000), (2, None, "x"), (None, "u", "y"), (2, None, "x")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"), least=10, compress=False)
    rows = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((r["page_id"] or 0, r["payload"].decode(), r["whole"]) for r in rows) == [
        (0, "y", True), (1, "é" * 100_000, True), (2, "x", True), (2, "x", True)
    ]
    assert {r["record_type"] for r in rows} == {"response"}


def test_a_missing_segment_is_told():
    records = list(warc.records_of(1, "u", b"x" * 100_000, False, None, "2000-01-01T00:00:00Z"))
    assert len(records) == 4
    fields, blocks = zip(*warc.parsed(b"".join(r + b"\r\n\r\n" for r in records)))
    assert warc.payload_of(b"".join(blocks)) == b"x" * 100_000
    with pytest.raises(ValueError):
        warc.payload_of(b"".join(blocks[:-1]))


# 7: language


def test_language(spark, edge, texts):
    found = by_id(result(spark, "op7_language_id", edge))
    assert set(found) == set(texts)
    for name, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(name).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[name]))


def test_language_accuracy_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    found = by_id(result(spark, "op7_language_id", where))
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    held = [row for row in found.values() if row["held_out"] and row["lang_pred"] != "und"]
    right = sum(truth[row["doc_id"]] == row["lang_pred"] for row in held)
    assert right >= 0.97 * len(held) > 0


def test_gradients_against_differences():
    dice = np.random.default_rng(1)
    net = language_id.trained([], [])
    net = language_id.Network(
        ["a", "b"], dice.normal(size=(257, 8)), {w: dice.normal(size=(w * 8, 8)) for w in (2, 3, 4)},
        dice.normal(size=24), dice.normal(size=(24, 2)), dice.normal(size=2),
    )
    data, target = dice.integers(0, 256, (3, language_id.WINDOW)), np.array([0, 1, 1])

    def loss():
        net.tables = []
        hidden = []
        for width, kernel in net.filters.items():
            count = language_id.WINDOW - width + 1
            patches = np.stack([net.embedding[data[:, i : i + width]].reshape(3, -1) for i in range(count)], 1)
            hidden.append((patches @ kernel).max(axis=1))
        hidden = np.maximum(np.concatenate(hidden, 1) + net.shift, 0)
        p = language_id._softmax(hidden @ net.weights + net.bias)
        return -np.log(p[np.arange(3), target]).mean()

    values = [net.embedding, *net.filters.values(), net.shift, net.weights, net.bias]
    for value, gradient in zip(values, language_id._gradients(net, data, target)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        value[at] += 1e-6
        up = loss()
        value[at] -= 2e-6
        down = loss()
        value[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(gradient[at], rel=1e-3)


# 8: packing


def test_packing(spark, edge, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result(spark, "op8_best_fit_packing", edge)
    documents, sequences = {}, {}
    for row in rows:
        documents.setdefault(row["doc_id"], []).append(row)
        sequences.setdefault(row["sequence_id"], []).append(row)
    assert set(documents) == set(texts)
    for name, some in documents.items():
        ids = tokenizer.encode(texts[name], add_special_tokens=False).ids + [0]
        some.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in some] == list(range(len(some)))
        assert all(r["length"] == 2048 for r in some[1:]) and len(some) == -(-len(ids) // 2048)
        at = 0
        for r in some:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_crossover_keeps_every_item_once():
    import random

    dice = random.Random(2)
    lengths = [dice.randint(1, 100) for _ in range(300)]
    population = packing.evolved(lengths, 100, [], 1)
    for some in population:
        assert sorted(i for items in some for i in items) == list(range(300))
        assert all(sum(lengths[i] for i in items) <= 100 for items in some)
    assert packing._restored(packing._stored(population, 300), 300)[0].__len__() == len(population[0])


def test_evolution_finds_what_best_fit_misses():
    """200 sequences of three pieces each that fill them exactly, and lengths between a seventh and a half."""
    import random

    dice = random.Random(3)
    triples = []
    for _ in range(200):
        a = dice.randint(780, 1000)
        b = dice.randint(512, (2048 - a) // 2)
        triples += [a, b, 2048 - a - b]
    for lengths, share in ((triples, 0.9), ([dice.randint(300, 1200) for _ in range(2000)], 0.995)):
        falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        plain = len(packing.best_fit(lengths, 2048, falling))
        population = []
        for epoch in range(2):
            population = packing.evolved(lengths, 2048, population, epoch)
        best = population[0]
        assert sorted(i for items in best for i in items) == list(range(len(lengths)))
        assert max(sum(lengths[i] for i in items) for items in best) <= 2048
        assert -(-sum(lengths) // 2048) <= len(best) <= share * plain


def test_displaced_pieces_take_the_place_of_smaller_ones():
    lengths = [50, 30, 60, 35, 10, 90]
    found = packing.refilled(lengths, 100, [[0, 1], [5]], [2, 3, 4])
    assert sorted(i for items in found for i in items) == list(range(6))
    assert len(found) == 3 and all(sum(lengths[i] for i in items) <= 100 for items in found)


def test_rests_of_blocks_meet(spark, monkeypatch):
    """Pooling the rests of blocks takes fewer sequences than packing each block alone."""
    monkeypatch.setattr(packing, "BLOCK", 40)
    rows = spark.createDataFrame([(i, 1 + i * 37 % 99, "x") for i in range(200)], "k int, length int, offset string")

    def sequences():
        found = packing.pack(rows, 100).collect()
        assert sorted(r["k"] for r in found) == list(range(200))
        used = {}
        for r in found:
            used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        assert max(used.values()) <= 100
        return len(used)

    pooled = sequences()
    monkeypatch.setattr(packing, "SETTLED", 0)
    assert 100 <= pooled < sequences()


# 10: Elias-Fano


def test_elias_fano_archive(spark, edge, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(result(spark, "op10_elias_fano", edge))
    assert set(found) == set(texts)
    start = 0
    for name in sorted(texts):
        ids = tokenizer.encode(texts[name], add_special_tokens=False).ids + [2]
        assert found[name]["n_tokens"] == len(ids), texts[name][:50]
        assert found[name]["start"] == start
        assert found[name]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 1, 7, 1000, 1 << 40], list(range(0, 70_000, 7))])
def test_elias_fano_sequence(values):
    coded = elias_fano.EliasFano.of(np.array(values, dtype=np.uint64))
    again = elias_fano.EliasFano.from_bytes(coded.to_bytes())
    assert again.values().tolist() == values
    assert [again.select(i) for i in range(len(values))] == values
    if len(values) > 1000:
        assert len(coded.to_bytes()) < len(values)  # under 8 bits a value


def test_documents_are_found_by_select(monkeypatch):
    """Reading a segment expands neither of its sequences."""
    names = [None, None, -7, -7, *range(0, 9000, 9)]
    rows = [np.arange(i % 40 + 1, dtype="<u4") + i for i in range(len(names))]
    ((head, body),) = elias_fano.segments(elias_fano.segment(0, 0, 0, names, [r.tobytes() for r in rows]) + elias_fano.TRAILER.encode())
    monkeypatch.delattr(elias_fano.EliasFano, "values")
    found = list(elias_fano.documents_of(head, body))
    assert [name for name, _, _ in found] == names
    assert [start for _, start, _ in found] == np.cumsum([0, *map(len, rows[:-1])]).tolist()
    assert all(np.array_equal(ids, row) for (_, _, ids), row in zip(found, rows))


def test_archive_of_small_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(elias_fano, "SEGMENT_IDS", 20)
    docs = spark.createDataFrame([(i - 50, f"{i} some words here {'x ' * (i % 9)}") for i in range(100)] + [(None, None)], "doc_id long, text string")
    elias_fano.write(docs, str(tmp_path / "a"), public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = sorted(elias_fano.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, *range(-50, 50)]
    ends = [r["start"] + r["n_tokens"] for r in rows]
    assert [r["start"] for r in rows] == [0, *ends[:-1]]


@pytest.mark.parametrize("name, cuts", [("byte_bpe_50k.json", "byte_level"), ("word_bpe_49k.json", "words")])
def test_texts_in_parts_have_the_librarys_ids(name, cuts, monkeypatch):
    """White space of every kind in every place, named tokens, letters that are cut off or not; a memo that overflows."""
    import random

    monkeypatch.setattr(library_tokens, "MEMO", 3000)
    monkeypatch.setattr(library_tokens, "LEARNT", 70)
    dice = random.Random(1)
    letters = list(" \n\t\r\x0b\x1c\x85\xa0 　aBéßà日本1!😀́İſ") + [" ", " ", "\n", "'s", "don't", "...", "ΣΑΣ", "the"]
    named = ["<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(dice.choice(letters + (named if dice.random() < 0.02 else [])) for _ in range(dice.randrange(14))) for _ in range(9000)]
    texts += [None, "", " ", "\n", *named, "x" * 5000, "é" * 5000]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = library_tokens.Encoder(public_tokenizers.path(name), cuts)
    for start in range(0, len(texts), 700):
        some = texts[start : start + 700]
        expected = [x.ids for x in tokenizer.encode_batch([text or "" for text in some], add_special_tokens=False)]
        for array in (pa.array(some, pa.string()), pa.array([None, *some], pa.large_string()).slice(1)):
            assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(array)] == expected
    assert encoder.encode(pa.array([], pa.string())) == []


def test_blocks_spread_over_salts(spark):
    """One block in each of 64 partitions, and 64 salts: no salt holds more than a few."""
    blocks = spark.range(0, 64, 1, 64).select(exact_topk.salt(64).alias("salt"))
    sizes = [row["count"] for row in blocks.groupBy("salt").count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 5


def test_queries_that_are_no_candidates_get_all_their_rows(spark):
    """Scores far below the candidates' own squares."""
    candidates = spark.createDataFrame([(i, [1, i]) for i in range(40)], "id long, vector array<long>")
    queries = spark.createDataFrame([(100, [-900000, -5]), (101, [0, 0])], "id long, vector array<long>")
    found = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in exact_topk.top_k(candidates, queries, 10).collect())
    assert found == [(100, i + 1, i, -900000 - 5 * i) for i in range(10)] + [(101, i + 1, i, 0) for i in range(10)]


def test_language_sample_shuffles_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = language_id.sampled(docs.select("doc_id", "text", "lang"), 300)
    rows = sample.collect()
    assert 200 < len(rows) < 400 and all(len(text) <= language_id.EXCERPT for row in rows for text in row["excerpts"])
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "hashpartitioning" not in plan
