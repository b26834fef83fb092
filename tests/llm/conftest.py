import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _score int, id string"


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "an", "on", "ti", "ing", "ou")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = words(1, 120)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, base, "en", "a", 5, "k", 1, "x"),
        (2, base, "en", "a", 5, "k", 1, "x"),
        (3, " ".join(near), None, None, None, None, None, None),
        (4, words(2, 150), "en", "a", 1, "k", 1, "x"),
        (5, None, "en", "a", 0, "k", 1, "x"),
        (6, "", "en", "a", 0, "k", 1, "x"),
        (7, " \n\t ", "en", "a", 0, "k", 1, "x"),
        (8, "two words", "en", "a", 0, "k", 1, "x"),
        (9, "Two  WORDS", "en", "a", 0, "k", 1, "x"),
        (10, words(3, 30_000), "en", "a", 0, "k", 1, "x"),
        (11, "mail a.b@c.example.org, call +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.256 and 10.0.0.1", "en", "a", 0, "k", 1, "x"),
        (4, words(2, 150), "en", "a", 1, "k", 1, "x"),
        (None, words(4, 40), "en", "a", 1, "k", 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
