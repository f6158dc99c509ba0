from __future__ import annotations

import numpy as np
import pytest

from modlytics.llm import ann as A

SMALL = A.Settings(leaf=64, queries=8, step=16)


def exact(rows: list, every: int, k: int) -> dict:
    """Brute force over all valid rows."""
    good = [(i, key, np.array(v, float)) for i, (key, v) in enumerate(rows) if v and key is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    found = {}
    for i, key, vector in good:
        if key % every == 0:
            scored = sorted((-float(other @ vector), name) for j, name, other in good if j != i)
            found[key] = [(name, -minus) for minus, name in scored[:k]]
    return found


def answers(out: list) -> dict:
    found: dict = {}
    for row in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    return found


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    return [(i, [float(x) for x in rng.standard_normal(16) * (1 + i % 3)]) for i in range(600)]


def test_recall_and_scores(spark, rows):
    got = answers(A.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 20, 20, settings=SMALL).collect())
    want = exact(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = sum(len({key for key, _ in got[q]} & {key for key, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {key: np.array(v) for key, v in rows}
    for q, found in got.items():
        assert len(found) == 20 and q not in {key for key, _ in found}
        assert found == sorted(found, key=lambda hit: (-hit[1], hit[0]))
        assert all(abs(score - vectors[q] @ vectors[key]) < 1e-9 for key, score in found)


def test_ties_copies_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(100)]
    rows += [(200, None), (220, [0.0] * 3), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf")] * 3), (300, [1.0]), (None, [1.0] * 3)]
    out = A.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, 20, settings=SMALL).collect()
    got = answers(out)
    assert set(got) == {0, 20, 40, 60, 80}
    assert [key for key, _ in got[0]] == [1, 2, 3, 4, 5] and [key for key, _ in got[20]] == [0, 1, 2, 3, 4]


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert answers(A.neighbours(frame, 20, 2, settings=SMALL).collect()) == {2: [(3, 0.0)]}
    empty = A.neighbours(frame.limit(0))
    assert empty.count() == 0 and empty.columns[:4] == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_quantile():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507) < 0.01 and abs(A.chi_square_quantile(0.95, 2) - 5.991) < 0.01


def recall(got: dict, want: dict) -> float:
    hits = sum(len({key for key, _ in got.get(q, [])} & {key for key, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_with_the_settings_of_the_query(spark):
    """The given vectors, as many leaves as a smaller leaf makes, all else as in the query."""
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(row["vec_id"], [float(x) for x in row["embedding"]] if row["embedding"] is not None else None) for row in frame.collect()]
    out = A.neighbours(frame, 20, 20, settings=A.Settings(leaf=128)).collect()
    assert recall(answers(out), exact(rows, 20, 20)) >= 0.9


def test_leaves_are_pruned(spark):
    """Clusters that lie apart: a query verifies little beyond its own."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 12)) * 20
    rows = [(i, [float(x) for x in centres[i % 16] + rng.standard_normal(12)]) for i in range(1600)]
    out = A.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 10, 20, settings=A.Settings(leaf=100)).collect()
    verified = {row.query_id: row.verified for row in out}
    assert recall(answers(out), exact(rows, 20, 10)) >= 0.9
    assert sum(verified.values()) < 0.35 * 1600 * len(verified)


@pytest.mark.parametrize("scale", [1e-170, 1e-300, 1e150])
def test_very_small_and_very_large_vectors_take_part(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * scale]) for i in range(40)]
    rows += [(100 + i, [float(x) for x in rng.standard_normal(8)]) for i in range(20)]
    out = answers(A.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, 20, settings=SMALL).collect())
    assert set(out) == {0, 20, 100} and all(len(found) == 5 for found in out.values())
    assert recall(out, exact(rows, 20, 5)) >= 0.9


def test_columns_of_other_names_do_no_harm(spark, rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows[:100], "vec_id bigint, embedding array<double>")
    extra = frame.select("*", *(F.lit("x").alias(name) for name in ("id", "row", "leaf", "raw", "hits", "seen", "vector", "bound", "largest")))
    assert answers(A.neighbours(extra, settings=SMALL).collect()) == answers(A.neighbours(frame, settings=SMALL).collect())
