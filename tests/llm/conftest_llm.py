"""Fixtures and rows that the tests of this folder share."""

import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture
def documents(spark):
    """A documents table with columns whose names the operators use inside."""

    def build(rows):
        schema = (
            "doc_id long, text string, node long, bucket string, place int, text_key string, doc_key int, block int, "
            "host string, n int, root int, _staying_id int, anchor int, lang string"
        )
        return spark.createDataFrame([(*row, *[None] * 12) for row in rows], schema)

    return build


#: Nulls, empty and blank texts, a short one, repeated rows and a very long text.
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "A b c"), (4, "A b c"), (5, "a  b\tc"), (None, "x y z"), (None, None),
    (6, "word " * 40_000), (7, "é" * 3), (8, "A b c"),
]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))
