"""Near duplicates, repeated passages and the pipeline against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import components, jaccard_join, packing, queries, suffix_dedup


def words(text):
    return (text or "").encode().split()


def least(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def groups(texts):
    """By position: number of shingles and first position of the component."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for text in texts:
        w = words((text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((least(parent, i), least(parent, j)))
                parent[y] = x
    return [(len(s), least(parent, i)) for i, s in enumerate(sets)]


def repeats(rows):
    """Of (id, text): covered and removed words of each id."""
    found = defaultdict(list)
    for name, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - 49):
            found[tuple(w[i : i + 50])].append((name, i))
    covered, gone, kept = defaultdict(set), defaultdict(set), defaultdict(set)
    for places in found.values():
        if len(places) > 1:
            for name, i in places:
                covered[name].update(range(i, i + 50))
                (kept if (name, i) == min(places) else gone)[name].update(range(i, i + 50))
    return covered, {name: gone[name] - kept[name] for name in gone}


def near_copies(dice, count=40, size=120, edits=3):
    base = [f"w{dice.randrange(500)}" for _ in range(size)]
    for _ in range(count):
        copy = list(base)
        for _ in range(dice.randrange(edits + 1)):
            copy[dice.randrange(size)] = f"e{dice.randrange(50)}"
        yield " ".join(copy)


@pytest.fixture(scope="module")
def copies():
    """Near copies in chains, shared passages, mosaics of common passages, short texts."""
    dice = random.Random(11)
    texts = [*near_copies(dice), *near_copies(dice, 30, 60, 4)]
    passages = [" ".join(f"p{dice.randrange(300)}" for _ in range(60)) for _ in range(5)]
    for _ in range(60):
        own = " ".join(f"o{dice.randrange(3000)}" for _ in range(dice.choice([0, 5, 30, 300])))
        texts.append(f"{dice.choice(passages)} {own} {dice.choice(passages)}")
    chain = [f"c{i}" for i in range(100)]
    for step in range(0, 60, 6):
        texts.append(" ".join([*[f"d{i}" for i in range(step)], *chain[step:]]))
    texts += ["a b c", "A B c", "a b", "", None, " \n", "The The " * 60, "the the " * 60]
    return [(100 + i, text) for i, text in enumerate(texts)]


@pytest.mark.parametrize("rounds", [jaccard_join.FRUITFUL, 0])
def test_groups(spark, copies, monkeypatch, rounds):
    """With all star rounds, and with one only, so that the rest has to find the links."""
    monkeypatch.setattr(jaccard_join, "FRUITFUL", rounds)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(docs).collect()}
    expected = groups([text for _, text in copies])
    assert found == {name: (n, 100 + first) for (name, _), (n, first) in zip(copies, expected)}
    assert len(set(x for _, x in expected)) < len(copies) - 50


def test_representatives(spark, copies):
    docs = spark.createDataFrame([(name, text, "x") for name, text in copies], "doc_id long, text string, gone_id string")
    found = {r["doc_id"]: r for r in jaccard_join.representatives(docs).collect()}
    expected = groups([text for _, text in copies])
    assert set(found) == {name for i, (name, _) in enumerate(copies) if expected[i][1] == i or not expected[i][0]}
    assert docs.columns == ["doc_id", "text", "gone_id"]


def test_groups_with_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (None, "no id here at all"), (2, text + " more"), (2, "another text of id two")]
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == [
        ("1", 36, "1"), ("1", 36, "1"), ("2", 1, "2"), ("2", 37, "1"), ("None", 1, "None"), ("None", 36, "1")
    ]


def test_one_physical_row_of_each_group_stays(spark):
    """Repeated rows, copies without an id, and groups where some have one; rows without words all stay."""
    texts = [" ".join(f"{letter}{i}" for i in range(40)) for letter in "abcd"]
    rows = [(1, texts[0])] * 3 + [(2, texts[0] + " more")]
    rows += [(None, texts[1])] * 2 + [(None, texts[1] + " more")]
    rows += [(None, texts[2]), (7, texts[2]), (8, texts[2])] + [(9, texts[3])] + [(None, " "), (None, " "), (4, None), (4, None)]
    docs = spark.createDataFrame([(name, text, i) for i, (name, text) in enumerate(rows)], "doc_id long, text string, row long")
    (_, stage), = [x for x in corpus_pipeline.STAGES if x[0] == "jaccard_join"]
    found = [tuple(r) for r in stage(spark, docs.repartition(3), "").collect()]
    assert all(rows[row] == (name, text) for name, text, row in found)
    assert len({row for _, _, row in found}) == len(found)
    assert sorted(str(name) for name, text, _ in found if words(text)) == ["1", "7", "9", "None"]
    assert sorted(str(name) for name, text, _ in found if not words(text)) == ["4", "4", "None", "None"]


@pytest.mark.parametrize("name", ["edge", "copies"])
def test_repeats(spark, edge, copies, name):
    docs = spark.read.parquet(f"{edge}/documents.parquet") if name == "edge" else spark.createDataFrame(copies, "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    covered, gone = repeats(rows)
    found, removed = defaultdict(set), defaultdict(int)
    for r in suffix_dedup.spans(docs.repartition(5)).collect():
        found[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
        removed[r["doc_id"]] += r["removed_words"]
    assert found == covered
    assert {k: v for k, v in removed.items() if v} == {k: len(v) for k, v in gone.items() if v}
    cleaned = suffix_dedup.cleaned(docs)
    assert cleaned.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for key, text in rows:
        if gone.get(key):
            assert words(texts[key]) == [w for i, w in enumerate(words(text)) if i not in gone[key]]
        else:
            assert texts[key] == text


def sources(rows):
    """Of (id, text): the document of the first place of each repeated passage's first window."""
    found = defaultdict(list)
    for name, text in rows:
        w = words(text)
        for i in range(len(w) - 49):
            found[tuple(w[i : i + 50])].append((name, i))
    first = {place: min(places)[0] for places in found.values() if len(places) > 1 for place in places}
    expected, last = set(), None
    for name, i in sorted(first):
        if last is None or last[0] != name or i > last[1] + 50:
            expected.add((name, i, first[name, i]))
        last = name, i
    return expected


def test_source_of_copies_that_send_no_windows(spark):
    """The first document holds the passage among other text; copies of another one name it all the same."""
    passage = " ".join(f"p{i}" for i in range(52))
    copy = passage + " " + " ".join(f"t{i}" for i in range(200))
    rows = [(3, " ".join(f"o{i}" for i in range(60)) + f" {passage} and on " + " ".join(f"r{i}" for i in range(60)))]
    rows += [(name, copy) for name in (5, 9, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["first_word"], r["source_id"]) for r in suffix_dedup.spans(docs).collect()}
    assert found == sources(rows) == {(3, 60, 3), (5, 0, 3), (9, 0, 3), (11, 0, 3)}


def test_source_of_a_run_over_several_ranges(spark, monkeypatch):
    """Copies enough that ranges cut the run of one suffix."""
    monkeypatch.setattr(suffix_dedup, "SORTED_ROWS", 40)
    sizes = []
    monkeypatch.setattr(suffix_dedup, "pieces_of", lambda rows, each: sizes.append(rows) or -(-rows // each))
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(None, "x y")] + [(name, passage) for name in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["first_word"], r["source_id"]) for r in suffix_dedup.spans(docs.repartition(4)).collect()}
    assert found == sources(rows[1:]) == {(name, 0, 2) for name in range(2, 600)}
    assert sizes[0] > 10 * suffix_dedup.SORTED_ROWS


def test_repeated_rows_both_stay(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, "before " + text + " after"), (None, "x " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The one without an id comes first.
    assert sorted(str(r["text"]) for r in suffix_dedup.cleaned(docs).collect()) == ["", "", "before after", "x " + text]


def test_texts_of_equal_short_hashes_stay_apart(spark):
    """Texts without an id, in pairs of one 32-bit hash, and a fifth, which all share 60 words: the first keeps them."""
    shared = " ".join(f"s{i}" for i in range(60))
    tried = spark.range(300_000).selectExpr(f"concat('{shared} ', 'a', id, ' b c d') AS text").withColumn("short", F.hash("text"))
    pairs = tried.groupBy("short").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").limit(2).collect()
    assert len(pairs) == 2
    texts = [text for pair in pairs for text in sorted(pair.texts)[:2]] + [shared + " e f g h"]
    docs = spark.createDataFrame([(None, text) for text in texts], "doc_id long, text string").repartition(3)
    found = sorted(len(words(r["text"])) for r in suffix_dedup.cleaned(docs).collect())
    assert found == [4, 4, 4, 4, 64]


def test_removal_keeps_the_text_around():
    assert suffix_dedup.without("a  b\nc d", [1, 3]) == "a d"
    assert suffix_dedup.without(" a b c", [0, 1]) == " b c"
    assert suffix_dedup.without("a b c ", [2, 3, 0, 1]) == " b "


def test_components_of_a_long_chain(spark):
    dice = random.Random(4)
    names = dice.sample(range(10_000), 300)
    edges = [(a, b) for a, b in zip(names[:200], names[1:200])] + [(a, b) for a, b in zip(names[200:], names[201:])]
    found = components.labels(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in found} == {
        **dict.fromkeys(names[:200], min(names[:200])), **dict.fromkeys(names[200:], min(names[200:]))
    }


def test_pipeline(spark, edge, empty):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    before = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, edge)
        assert docs.columns == columns, name
        found = docs.collect()
        left = [r["doc_id"] for r in found]
        assert len(set(left)) == len(left) and set(left) <= before, name
        if name == "jaccard_join":
            order = sorted(before)
            expected = groups([rows[i]["text"] for i in order])
            assert set(left) == {order[i] for i, (n, first) in enumerate(expected) if first == i or not n}
        if name == "suffix_dedup":
            covered, gone = repeats([(i, rows[i]["text"]) for i in before])
            for r in found:
                text = rows[r["doc_id"]]["text"]
                expected = [w for i, w in enumerate(words(text)) if i not in gone.get(r["doc_id"], ())]
                assert words(r["text"]) == expected and r["n_chars"] == len(r["text"])
            assert set(left) == before
        before = set(left)
        docs = spark.createDataFrame(found, docs.schema)
    assert before
    whole = corpus_pipeline.run(spark, edge)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == before
    assert corpus_pipeline.run(spark, empty).collect() == []
