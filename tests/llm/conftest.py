import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("th", "er", "on", "st", "qu") for b in ("a", "é", "i", "ou") for c in ("n", "r", "ble", "ß")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


#: Rows that every operator must take: nulls in any column, empty and blank texts, repeats, ties, a very long text.
def awkward() -> list[tuple]:
    rng = random.Random(1)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n\r", "b"), (4, "one", "a"), (5, "One two", "b"), (6, long, "a"), (7, same, "b"), (7, same, "b"), (8, "".join(c.upper() if c.isascii() else c for c in same), None), (9, same + " tail", "c"), (None, same, "a")]
    rows += [(100 + k, prose(rng, rng.randint(1, 120)), rng.choice("abc")) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Awkward documents with extra columns whose names clash with those that operators make."""
    rows = [(*r, "x", 1, "y") for r in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string, size int, score string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
