"""Edge-case documents and a helper for the tests of the training-data operators."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, t int, node string, key string"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "word", "stone", "river", "tree"]) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, very long texts, ties, repeated rows and copies; unique ids but for one repeated row."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split(" ")
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = sentence(rng, 50)
    long = "\n".join(sentence(rng, 40) for _ in range(500))
    texts = [
        (1, base, "en", "a"), (2, near, "en", "b"), (3, base, "en", "c"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n\x0b ", "en", "b"), (7, "Tiny", "de", "c"),
        (8, sentence(rng, 20) + " " + passage + " " + sentence(rng, 20), "en", "a"), (9, passage + " " + sentence(rng, 60), "fr", "b"), (10, long, "en", "a"),
        (11, "x " * 90, "en", None), (12, "  ".join(["x"] * 3), "en", None), (13, "tiny", "de", "z"), (14, "é😀  word #&%", "es", ""), (15, sentence(rng, 34), None, "a"), (16, sentence(rng, 35), None, "a"),
        (None, sentence(rng, 40), "en", "b"), (18, "1234 5678", "en", "b"), (19, long + "\n" + passage, "en", "d"), (1, base, "en", "a"),
    ]
    return [(i, t, g, s, len(t or ""), "clash", 0, "clash", "clash") for i, t, g, s in texts]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
