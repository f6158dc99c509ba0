from __future__ import annotations

import pytest

from modlytics.operators import profile
from modlytics.schema import LABELS


def test_missing_columns_are_named_in_label_order(spark):
    df = spark.createDataFrame([("test", 1)], "comment_text string, toxic int")
    with pytest.raises(ValueError) as problem:
        profile.require_columns(df)
    expected = ["severe_toxic", "obscene", "threat", "insult", "identity_hate"]
    assert str(problem.value) == f"Missing target columns: {expected}"


def test_counts_shape_and_statistics(spark, comments):
    more = comments.unionByName(
        spark.createDataFrame([("7", None)], "comment_id string, comment_text string"),
        allowMissingColumns=True,
    )
    nulls = {r.column_name: r.null_count for r in profile.null_counts(more).collect()}
    assert nulls["comment_text"] == 1 and nulls["comment_id"] == 0 and nulls["threat"] == 1
    shape = profile.dataset_shape(more).first()
    assert (shape.row_count, shape.column_count) == (7, 8)
    stats = {r.label: r for r in profile.label_statistics(more).collect()}
    assert stats["toxic"].positive_count == 2 and stats["toxic"].total_count == 7
    # The rate is over known labels, as a mean over a column with a gap is.
    assert stats["toxic"].positive_rate == pytest.approx(2 / 6)
    assert list(stats) == list(LABELS)


def test_prepare_dataset(comments):
    rows = {r.comment_id: r for r in profile.prepare_dataset(comments).collect()}
    assert rows["2"].clean_text == "you are so stupid and ugly"
    assert rows["2"].labels == [1, 0, 1, 0, 1, 0]
    sections = {r.section for r in profile.dataset_profile(comments).collect()}
    assert sections == {"shape", "missing_values", "label_statistics"}


def test_validate_training(spark, comments):
    features = comments.select("comment_id", "comment_text")
    labels = comments.select("comment_id", *LABELS)
    profile.validate_training(features, labels)
    cases = [
        (None, labels, "Input features and labels cannot be None"),
        (features.limit(0), labels, "Input features and labels cannot be empty"),
        (features.filter("comment_id < '4'"), labels, "must have same length: 3 vs 6"),
        (features, labels.drop("threat"), "Labels must have 6 columns, got 5"),
    ]
    for left, right, message in cases:
        with pytest.raises(ValueError, match=message):
            profile.validate_training(left, right)


def test_same_length_but_other_keys_is_an_error(spark, comments):
    from pyspark.sql import functions as F

    moved = comments.withColumn("comment_id", F.concat(F.lit("x"), "comment_id"))
    with pytest.raises(ValueError, match="same length: 6 vs 6"):
        profile.validate_training(comments, moved)


def test_repeated_and_null_keys(spark, comments):
    from pyspark.sql import functions as F

    same = comments.withColumn("comment_id", F.lit("1"))
    report = profile.validation_report(same, same).first()
    assert (report.feature_rows, report.label_rows, report.features_without_labels) == (6, 6, 0)
    fewer = profile.validation_report(same, same.limit(4)).first()
    assert (fewer.features_without_labels, fewer.labels_without_features) == (2, 0)
    nameless = comments.withColumn("comment_id", F.when(F.col("comment_id") != "3", F.col("comment_id")))
    with pytest.raises(ValueError, match="must have a comment_id"):
        profile.validate_training(nameless, nameless)


def test_requests(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("", 0.0), ("b" * 5000, 1.0), ("c" * 5001, 1.01), (None, None), ("d", -0.1)],
        "text string, confidence double",
    )
    rows = profile.validate_requests(df, shares=("confidence",)).collect()
    assert [r.valid for r in rows] == [True, False, True, False, False, False]
    assert [r.reasons for r in rows][1:] == [
        ["text_too_short"], [], ["text_too_long", "confidence_out_of_range"],
        ["text_missing"], ["confidence_out_of_range"],
    ]
    strict = profile.validate_requests(df, required=("confidence",)).collect()
    assert strict[4].reasons == ["text_missing", "confidence_missing"]
