"""What the service takes in is logged, committed and read by the reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from modlytics.operators.monitor import filter_feedback, parse_feedback, parse_predictions
from modlytics.plans import intake
from modlytics.plans.moderation import read_committed
from modlytics.schema import LABELS
from tests.conftest import at
from tests.test_streaming import scorer

WHEN = "2024-03-01 10:00:00"


@pytest.fixture
def requests(spark):
    made = [("1", "an insult"), ("2", "hello"), ("3", ""), ("4", None), ("5", "x" * 5001), ("6", "y" * 200)]
    return spark.createDataFrame(made, "comment_id string, comment_text string")


@pytest.mark.parametrize("scores", [False, True])
def test_answers_are_logged_once(spark, folder, requests, scores):
    run = lambda part: intake.answer_requests(requests, scorer, folder, part, at(spark, WHEN), scores)
    assert run("query=q/batch=0") and not run("query=q/batch=0")
    assert read_committed(spark, folder, "answers").count() == 3
    reasons = {r.comment_id: r.reasons for r in read_committed(spark, folder, "rejected").collect()}
    assert reasons == {"3": ["text_too_short"], "4": ["text_missing"], "5": ["text_too_long"]}
    rows = parse_predictions(intake.service_log(spark, folder)).orderBy("text_length").collect()
    assert [(r.text_length, r.is_toxic) for r in rows] == [(5, False), (9, True), (103, False)]
    assert {str(r.ts) for r in rows} == {WHEN}
    assert [r.max_probability for r in rows] == ([0.1, 0.8, 0.1] if scores else [0.0] * 3)
    assert [r.toxic_pred for r in rows] == ([False] * 3 if scores else [False, True, False])
    assert run("query=q/batch=1") and intake.service_log(spark, folder).count() == 6


def test_a_half_written_part_does_not_show(spark, folder, requests, monkeypatch):
    intake.answer_requests(requests, scorer, folder, "day=1", at(spark, WHEN))
    with monkeypatch.context() as patch:
        patch.setattr(intake, "put_once", lambda *_: (_ for _ in ()).throw(InterruptedError))
        with pytest.raises(InterruptedError):
            intake.answer_requests(requests, scorer, folder, "day=2", at(spark, WHEN))
    assert intake.service_log(spark, folder).count() == 3
    assert intake.answer_requests(requests, scorer, folder, "day=2", at(spark, WHEN))
    assert intake.service_log(spark, folder).count() == 6


def test_feedback(spark, folder):
    flags = {label: label == "toxic" for label in LABELS}
    scores = dict.fromkeys(LABELS, 0.25)
    given = [("right", flags, scores, flags, None), ("wrong", flags, scores, dict.fromkeys(LABELS, False), "no"),
             (None, flags, scores, flags, None), ("no labels", flags, scores, None, None)]
    df = spark.createDataFrame(
        given, "request_text string, predicted_labels map<string,boolean>, predicted_probabilities map<string,double>, "
        "true_labels map<string,boolean>, user_comments string").withColumn("created_at", at(spark, WHEN))
    assert intake.take_feedback(df, folder, "day=1")
    log = intake.service_log(spark, folder)
    assert {r.request_text: r.is_prediction_correct for r in filter_feedback(log).collect()} == {"right": True, "wrong": False}
    assert parse_feedback(log).filter("toxic_predicted").count() == 2
    rejected = [r.reasons for r in read_committed(spark, folder, "rejected").collect()]
    assert sorted(rejected) == [["request_text_missing"], ["true_labels_missing"]]


def test_reviews(spark, folder):
    given = [("q1", "allow", "fine"), ("q2", "reject", None), (None, "warn", None), ("q3", "explode", None), ("q4", None, None)]
    df = spark.createDataFrame(given, "queue_id string, action string, moderator_notes string").withColumn(
        "reviewed_at", at(spark, WHEN))
    assert intake.take_reviews(df, folder, "day=1")
    assert {r.queue_id: r.action for r in read_committed(spark, folder, "reviews").collect()} == {"q1": "approve", "q2": "reject"}
    assert {r.queue_id: r.action for r in intake.service_log(spark, folder).collect()} == {"q1": "approve", "q2": "reject"}
    assert sorted(r.reasons[0] for r in read_committed(spark, folder, "rejected").collect()) == [
        "action_missing", "action_unknown", "queue_id_missing"]


def test_files_of_the_log_are_in_the_order_of_time(spark, folder):
    from modlytics.sources.logs import log_items, write_log

    ids = spark.range(500).select("id", F.timestamp_seconds(1_709_251_200 + F.pmod(F.col("id") * 7919, F.lit(80_000))).alias("t"))
    write_log(log_items(ids, F.col("t")), folder)
    for path in {r[0] for r in spark.read.parquet(folder).select(F.input_file_name()).collect()}:
        times = [r.ts for r in spark.read.parquet(path).collect()]
        assert times == sorted(times) and times
