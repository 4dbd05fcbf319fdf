import random

import pytest
from llm_rows import make

@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, copy = prose(30_000), prose(120)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "a"), (5, copy, "b"), (6, copy, "b"), (7, copy + " tail", "b"),
        (None, copy, "b"), (None, prose(90), None), (8, "one", "c"), (9, "one two", "c"), (10, prose(80), None), (11, "a b c " * 200, "c"),
        (12, "Ünï çödé 日本 😀 " * 30, "é"), (13, "x\n" * 500, "a"), (13, "x\n" * 500, "a"), (13, prose(70), "a"),
        (14, "### $$$ " * 60, "b"), (15, 'token = "abcdefgh1234" AKIA' + "A" * 16 + " " + "0f" * 20, "a"),
    ]
    rows += [(100 + i, prose(rng.randint(1, 400)), rng.choice("abcde")) for i in range(60)]
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
