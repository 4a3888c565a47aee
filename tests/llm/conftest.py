from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in that is was for with on are house river stone light paper green quiet winter morning table garden letter window forest music ocean bridge candle mirror".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs."""

    def build(pairs):
        rows = [(i, t, "en", f"src{(i or 0) % 5}", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def corpus():
    """(id, text) pairs with the awkward cases: nulls, empty and white-space texts, ties, a
    long text, repeated rows and a null id."""
    rng = random.Random(11)
    pairs = [(i * 7, prose(rng, rng.randrange(1, 160))) for i in range(60)]
    pairs += [(1, None), (2, ""), (3, " \n \t "), (4, "Ünïcode ÉTÉ «ça» 　x y  two  spaces\n\n end "), (5, "a<|endoftext|>b <|startoftext|>")]
    pairs += [(1001, pairs[10][1]), (1002, pairs[10][1]), (1003, prose(rng, 30_000)), (1004, "x" * 50_000)]
    return pairs


@pytest.fixture(scope="session")
def clashing(make, corpus):
    """The corpus with columns whose names operators use inside."""
    names = ["row", "key", "doc", "text_", "block", "h1", "label", "features", "score", "n", "ids", "words", "fold", "set", "a", "b", "n_lines", "removed"]
    return make(corpus).select("*", *(F.lit("clash").alias(c) for c in names))
