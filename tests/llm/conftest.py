"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LETTERS = ["ab", "Cé", "the", "n't", "ß", "日本", "x|y", "1,5", "don't", "😀", "of", "in", "ΣΑΣ", "é"]


def sentence(dice, count):
    return " ".join(dice.choice(LETTERS) + dice.choice(["", "", ".", "ing", "s'"]) for _ in range(count))


def documents():
    dice = random.Random(3)
    texts = [
        None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nlines\n\n  end \n ", "　wide space\x85x\x1cy",
        "<|endoftext|> in text", "x" * 3000, "word " * 3000, "123 456\n" * 50, "| " * 40, "ends with space ",
    ]
    texts += [sentence(dice, dice.choice([3, 20, 120, 700])) for _ in range(60)]
    texts += [sentence(dice, 30_000), texts[-1], texts[-1], texts[20] + " more"]
    rows = [(i * 3 + 1, text, dice.choice(["en", "fr", None]), None, -1, "clash") for i, text in enumerate(texts)]
    return rows


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A table folder of such cases."""
    where = tmp_path_factory.mktemp("edge")
    rows = documents()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(
        [(row[0], int(i % 4 > 0), 0) for i, row in enumerate(rows)] + [(None, 1, 0), (1, None, None)],
        "doc_id long, quality int, toxic int",
    ).write.parquet(str(where / "labels.parquet"))
    dice = random.Random(5)
    vectors = [(i, [dice.choice([-0.5, 0.25, 0.125, 0.3]) for _ in range(4)], 1) for i in range(250)]
    vectors += [(300, None, 1), (400, [1.0, None, 0.0, 0.0], 1), (500, [float("nan")] * 4, 1), (600, [], 1), (700, [], 1)]
    vectors += [(800, [0.1, 0.2], 1), (801, [0.3, float("inf")], 1), (802, [0.5, 0.5], 1), (None, [1.0] * 4, 1), (7, [0.25] * 4, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(
        str(where / "embeddings.parquet")
    )
    pages = [(i, f"http://x/{i}?q=ä b", None if i % 9 == 0 else sentence(dice, i % 7 + 1) + "\r\n\r\nWARC/1.1\r\n") for i in range(60)]
    pages += [(100 + i, None, "same page") for i in range(20)] + [(200, "u", ""), (201, "u", "ü" * 60_000), (202, "u", "ü" * 60_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(
        str(where / "pages.parquet")
    )
    return str(where)


@pytest.fixture(scope="session")
def empty(spark, edge, tmp_path_factory):
    """The same tables without rows."""
    where = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{edge}/{name}.parquet").where("false").write.parquet(str(where / f"{name}.parquet"))
    return str(where)


@pytest.fixture(scope="session")
def texts(spark, edge):
    return {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{edge}/documents.parquet").collect()}
