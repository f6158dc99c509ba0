from __future__ import annotations

import random

import pytest

VOCAB = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Null keys and texts, empty and blank texts, repeated rows, a very long text, and clashing column names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(VOCAB) for _ in range(60_000))
    rows = [
        (1, "plain text of five words", "en", "a"),
        (1, "plain text of five words", "en", "a"),
        (2, None, None, None),
        (3, "", "en", None),
        (4, " \n\t ", "de", "b"),
        (None, "a text without a key", "en", "b"),
        (5, long, "en", "a"),
        (6, "tschüß naïve 漢字 \U0001f600 é", None, "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = ["row", "key", "ids", "spans", "kept", "size", "n", "score", "class_id", "draw", "c0", "label", "root"]
    from pyspark.sql import functions as F

    return frame.select("*", *(F.lit("x").alias(name) for name in extra))


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
