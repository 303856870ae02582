from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("row", "key", "id", "fp", "n", "doc", "spans", "site", "tie", "part", "words", "lang_pred", "score", "ids", "matches", "rule",
           "verdict", "host", "path", "component_id", "kept", "label")


def prose(rng: random.Random, n: int, vocabulary: list[str]) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def words(rng: random.Random, n: int, letters: str = "abcdefghilmnorstu") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = "one very long text without an end " * 4000
    rows = [
        (1, "A plain text with some ordinary words in it.", "en", "a", 44),
        (1, "A plain text with some ordinary words in it.", "en", "a", 44),
        (2, "A plain text with some ordinary words in it.", None, None, None),
        (3, None, "en", "b", None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", None, "c", 4),
        (6, long, "en", "c", len(long)),
        (7, "w" * 120_000, "en", None, 120_000),
        (None, "A row without an id, but with a text.", "en", "d", 37),
        (None, None, None, None, None),
        (8, "漢字 and é and 🙂 \x00 ▁ end", "en", "d", 22),
        (8, "another text of a repeated id", "en", "e", 29),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(c) for c in CLASHES})
