"""Fixtures of the training-data operators: rows with nulls, empty and long texts, ties, repeats."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, length string, mix int"


def _prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return _prose


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, near copies."""
    shared = _prose(99, 60)
    base = _prose(5, 400)
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n", "en", "a", 3),
        (4, base, "en", "b", 1),
        (4, base, "en", "b", 1),
        (5, base, "de", None, 1),
        (6, base + " tail", "de", "c", 1),
        (7, _prose(7, 20_000), "fr", "b", 1),
        (8, _prose(8, 70) + " " + shared + " " + _prose(9, 30), "en", "b", 1),
        (9, _prose(10, 10) + "\n" + shared + "\n" + _prose(11, 90), "en", "é", 1),
        (10, "x" * 60_000, None, "a", 1),
        (11, "one two", "en", "a", 1),
        (12, "ONE two", "en", "a", 1),
        (13, "naïve Ünïcode ﬁ ²½  日本語 ​ emoji 😀 <|endoftext|> a  b\n\n c", "en", "a", 1),
        (None, _prose(12, 60), "en", "a", 1),
        (None, None, None, None, None),
    ]
    return [(*r, "clash", "clash", 7) for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], DOCS)
