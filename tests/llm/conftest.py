import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _words string, rec string, id string, shard string, path string, n_lines string"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 10 + ["".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    words = [rnd.choice(vocabulary) for _ in range(n)]
    return "".join(w + ("\n" if rnd.random() < 0.05 else " ") for w in words).strip()


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    long = prose(5, 40_000)
    near = prose(6, 200)
    rows = [
        (0, prose(1, 120), "en", "a", 1), (1, prose(1, 120), "en", "b", 1), (2, near, "en", "a", 1),
        (3, near.rsplit(" ", 1)[0] + " changed", "de", "b", 1), (4, "", "en", "a", 0), (5, None, "en", "a", None),
        (6, " \t\n\x0b\x0c\r ", "en", None, 7), (7, long, None, "a", 1), (8, long, "en", None, 1), (None, prose(2, 80), None, None, None),
        (None, None, None, None, None), (9, "one two", "en", "c", 1), (9, "one two", "en", "c", 1), (10, "ab " * 100, "en", "c", 1),
        (11, "x" * 150_000, "en", "c", 1), (12, "mail a.b@c.example.org or +1 (772) 555-8768\npassword=e3b3ed3cc8548923d6", "en", "c", 1),
    ]
    return [(*r, "k", "w", "r", "i", "s", "p", "n") for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
