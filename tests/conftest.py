from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from modlytics.schema import LABELS  # noqa: E402
from modlytics.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "modlytics-tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="modlytics-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new folder per test; left for the system to clear."""
    return tempfile.mkdtemp(prefix="modlytics-test-")


COMMENTS = [
    ("1", "This is a good comment", 0, 0, 0, 0, 0, 0),
    ("2", "You are so stupid and ugly", 1, 0, 1, 0, 1, 0),
    ("3", "I hate you so much", 1, 1, 0, 1, 0, 1),
    ("4", "Great job on this project", 0, 0, 0, 0, 0, 0),
    ("5", "What a terrible day", 0, 0, 0, 0, 0, 0),
    ("6", "Love this community", 0, 0, 0, 0, 0, 0),
]


@pytest.fixture
def comments(spark):
    names = ", ".join(f"{label} int" for label in LABELS)
    return spark.createDataFrame(COMMENTS, f"comment_id string, comment_text string, {names}")


def scored_frame(spark, rows):
    """Rows of (id, text, six probabilities, six flags)."""
    probs = ", ".join(f"{label}_prob double" for label in LABELS)
    preds = ", ".join(f"{label}_pred boolean" for label in LABELS)
    flat = [(key, text, *p, *(bool(f) for f in flags)) for key, text, p, flags in rows]
    return spark.createDataFrame(flat, f"comment_id string, comment_text string, {probs}, {preds}")


INSULT = ((0.8, 0.1, 0.05, 0.02, 0.7, 0.01), (1, 0, 0, 0, 1, 0))
MILD = ((0.1, 0.1, 0.05, 0.02, 0.1, 0.01), (0, 0, 0, 0, 0, 0))
SEVERE = ((0.95, 0.9, 0.95, 0.02, 0.9, 0.01), (1, 1, 1, 0, 1, 0))


@pytest.fixture
def scored(spark):
    return scored_frame(
        spark,
        [
            ("a", "This is an insult.", *INSULT),
            ("b", "This is a friendly comment.", *MILD),
            ("c", "This is extremely toxic.", *SEVERE),
        ],
    )


def at(spark, text):
    from pyspark.sql import functions as F

    return F.lit(text).cast("timestamp")
