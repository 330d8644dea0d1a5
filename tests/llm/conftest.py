"""Documents with every odd case the operators define a result for."""

from __future__ import annotations

import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [
    (1, "the cat sat on the mat and the dog ran off to the old mill by the river", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n ", None),
    (5, "x", "fr"),
    (6, LONG, "en"),
    (7, "the cat sat on the mat and the dog ran off to the old mill by the river", "en"),
    (8, "¡Ünïcödé! 漢字かな \U0001f600 é don't", None),
    (None, "a row without an id", "en"),
    (1, "the cat sat on the mat and the dog ran off to the old mill by the river", "en"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Null ids, texts and languages, empty, blank, long and odd texts, repeated rows, clashing columns."""
    rows = [(i, t, lang, f"src{k}", None if t is None else len(t), k, "x", 0.5, True, 3) for k, (i, t, lang) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, key string, score double, kept boolean, n long")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").cache()


def odd_texts(n: int, seed: int) -> list[str]:
    """Random texts of words, white space of all kinds, digits, symbols and other scripts."""
    r = random.Random(seed)
    parts = ["the", "Quick", "über", "naïve", "don't", "it's", "12345", "3.14", "漢字", "é", "\U0001f600", "#!$", "--", "ſ", "İ", "ŉ", "<|endoftext|>", " ", " ", "a" * 40]
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r\n", "", ""]
    return ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.choice([0, 1, 5, 40, 400]))) for _ in range(n)]
