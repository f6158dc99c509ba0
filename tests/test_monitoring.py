"""Monitoring arithmetic on small logs, every figure worked out by hand."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from modlytics.operators import drift, monitor
from modlytics.plans.dashboard import dashboard
from modlytics.sources.logs import parse_log_lines
from tests.conftest import at
from tests.test_moderation import items  # noqa: F401

YES = {"toxic": True, "insult": True}
LOG = [
    {"timestamp": "2024-03-01T10:00:00+00:00", "endpoint": "/predict", "request_text": "abcd", "is_toxic": True,
     "prediction_latency": 0.2, "predictions": {"toxic": True, "insult": False}},
    {"timestamp": "2024-03-01 11:00:00,054", "endpoint": "/predict_proba", "request_text": "ab", "is_toxic": False,
     "prediction_latency": 0.4, "max_probability": 0.3, "probabilities": {"toxic": 0.3, "insult": 0.1}},
    {"timestamp": "2024-03-02T10:00:00+00:00", "endpoint": "/predict_proba", "is_toxic": True,
     "max_probability": 1.0, "probabilities": {"toxic": 1.0, "insult": 0.5}},
    {"timestamp": "no time", "endpoint": "/predict", "request_text": "x", "prediction_latency": 0.6,
     "predictions": {"toxic": False}},
    {"timestamp": "2024-03-02T11:00:00+00:00", "endpoint": "/feedback", "request_text": "abc", "predicted_labels": YES,
     "true_labels": {"toxic": True}, "is_prediction_correct": False},
    {"timestamp": "2024-03-02T12:00:00+00:00", "endpoint": "/feedback", "request_text": "abc", "predicted_labels": YES,
     "true_labels": YES, "is_prediction_correct": True, "user_comments": "ok"},
    {"timestamp": "2024-03-02T12:00:00+00:00", "endpoint": "/feedback", "is_prediction_correct": True},
    {"timestamp": "2024-03-02T13:00:00+00:00", "endpoint": "/moderate", "decision": "reject"},
]


@pytest.fixture
def logs(spark):
    lines = spark.createDataFrame([(json.dumps(record),) for record in LOG], "value string")
    return parse_log_lines(lines).drop("_corrupt_record")


def test_parsed_rows_and_defaults(logs):
    rows = monitor.parse_predictions(logs).orderBy("ts", "timestamp").collect()
    assert len(rows) == 4
    by_time = {r.timestamp: r for r in rows}
    first, second = by_time["2024-03-01T10:00:00+00:00"], by_time["2024-03-01 11:00:00,054"]
    assert (first.max_probability, first.toxic_prob, first.toxic_pred) == (0.0, 0.0, True)
    assert (second.max_probability, second.toxic_prob, second.toxic_pred) == (0.3, 0.3, False)
    assert by_time["2024-03-02T10:00:00+00:00"].text_length == 0
    assert by_time["no time"].ts is None and by_time["no time"].is_toxic is False
    kept = {r.timestamp: r for r in monitor.parse_predictions(logs, null_defaults=True).collect()}
    assert kept["2024-03-01T10:00:00+00:00"].toxic_prob is None
    assert kept["2024-03-01 11:00:00,054"].toxic_pred is None


def test_feedback_rows(logs):
    rows = monitor.parse_feedback(logs).collect()
    assert len(rows) == 2
    wrong = next(r for r in rows if not r.is_prediction_correct)
    assert wrong.user_comments == "" and wrong.text_length == 3
    assert (wrong.insult_predicted, wrong.insult_true, wrong.insult_correct) == (True, False, False)
    assert wrong.threat_correct is True
    table = monitor.feedback_table(logs).collect()
    assert len(table) == 3
    assert {r.is_insult for r in table} == {None, True} and all(r.is_threat is None for r in table)


def test_overview(spark, logs, items):  # noqa: F811
    row = monitor.overview(monitor.parse_predictions(logs), monitor.parse_feedback(logs), items).first()
    assert (row.total_predictions, row.toxicity_rate, row.total_feedback) == (4, 50.0, 2)
    assert row.user_accuracy == 50.0 and row.mean_latency == pytest.approx(0.4) and row.pending_reviews == 5
    none = monitor.overview(
        monitor.parse_predictions(logs.limit(0)), monitor.parse_feedback(logs.limit(0)), items.limit(0)
    ).first()
    assert (none.total_predictions, none.toxicity_rate, none.mean_latency, none.user_accuracy) == (0, None, None, None)


def test_daily_and_latency(logs):
    predictions = monitor.parse_predictions(logs)
    days = {str(r.date): tuple(r)[1:] for r in monitor.daily_toxicity(predictions).collect()}
    assert days == {"2024-03-01": (2, 1, 0.5), "2024-03-02": (1, 1, 1.0)}
    assert [r.prediction_latency for r in monitor.latency_series(predictions).collect()] == [0.2, 0.4]


def test_latency_order_with_many_rows_at_one_moment(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-03-02")).otherwise(F.lit("2024-03-01")).cast("timestamp").alias("ts"),
        (F.col("id") % 7 / 10).alias("prediction_latency"),
    )
    series = [(r.datetime, r.prediction_latency) for r in monitor.latency_series(df).collect()]
    assert len(series) == 3000 and series == sorted(series)


def test_daily_rate_ties_go_to_the_even_digit(spark):
    df = spark.range(16).select(
        F.lit("2024-03-01").cast("timestamp").alias("ts"), (F.col("id") == 0).alias("is_toxic")
    )
    assert monitor.daily_toxicity(df).first().toxic_rate == 0.062


def test_types(logs):
    predictions = monitor.parse_predictions(logs)
    frequency = monitor.type_frequency(predictions).collect()
    assert (frequency[0].toxicity_type, frequency[0].prediction_rate, frequency[0]["count"]) == ("Toxic", 0.25, 1)
    assert {r.prediction_rate for r in frequency[1:]} == {0.0} and len(frequency) == 6
    means = {r.toxicity_type: r.average_probability for r in monitor.type_confidence(predictions).collect()}
    assert means["Toxic"] == pytest.approx(1.3 / 4) and means["Insult"] == pytest.approx(0.15)
    alone = monitor.type_confidence(monitor.parse_predictions(logs, null_defaults=True)).collect()
    assert alone[0].average_probability == pytest.approx(0.65)


def test_label_performance(logs):
    rows = {r.toxicity_type: tuple(r)[1:] for r in monitor.label_performance(monitor.parse_feedback(logs)).collect()}
    # Labels nobody confirmed are left out.
    assert rows == {"Toxic": (1.0, 1.0, 1.0, 1.0), "Insult": (0.5, 0.5, 1.0, 0.667)}
    assert monitor.user_accuracy(monitor.parse_feedback(logs)).first().user_accuracy == 0.5


def test_alerts(spark, logs):
    predictions, feedback = monitor.parse_predictions(logs), monitor.parse_feedback(logs)

    def messages(p, f, as_of):
        return [(r.type, r.severity, r.message) for r in monitor.health_alerts(p, f, at(spark, as_of)).collect()]

    low = ("error", "High", "Overall model accuracy has dropped to 50.00% (below 80% threshold)")
    assert messages(predictions, feedback, "2024-03-02 20:00:00") == [low]
    assert messages(predictions, feedback, "2024-03-03 10:00:00") == [
        low, ("warning", "Medium", "No predictions made in the last 24 hours"),
    ]
    toxic = predictions.filter("is_toxic")
    assert messages(toxic, feedback.filter("is_prediction_correct"), "2024-03-02 20:00:00") == [
        ("warning", "Medium", "High toxicity rate detected: 100.00% of recent comments flagged as toxic")
    ]
    share = spark.range(100).select((F.col("id") < 85).alias("is_prediction_correct"))
    assert messages(predictions.limit(0), share, "2024-03-03") == [
        ("warning", "Medium", "Overall model accuracy is 85.00% (below 90% target)")
    ]
    exact = spark.range(10).select((F.col("id") < 9).alias("is_prediction_correct"))
    assert messages(predictions.limit(0), exact, "2024-03-03") == []
    assert messages(predictions.limit(0), feedback.limit(0), "2030-01-01") == []


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.0499, 0.05, 0.15, 0.35, 0.4999, 0.5, 0.95, 1.0, None)],
                               "max_probability double")
    rows = drift.confidence_histogram(df).orderBy("bin").collect()
    assert len(rows) == 20 and sum(r.rows for r in rows) == 9
    assert {r.bin: r.rows for r in rows if r.rows} == {0: 2, 1: 1, 3: 1, 7: 1, 9: 1, 10: 1, 19: 2}
    assert [r.bin for r in rows if r.above_threshold] == list(range(10, 20))


def test_box(spark):
    values = [0.1, 0.2, 0.3, 0.4, 1.0]
    df = spark.createDataFrame([(v, True) for v in values] + [(0.5, False)], "max_probability double, is_toxic boolean")
    rows = {r.prediction: r for r in drift.confidence_box(df).collect()}
    toxic = rows["Toxic"]
    assert (toxic.rows, toxic.q1, toxic.median, toxic.q3) == (5, 0.2, 0.3, 0.4)
    assert (toxic.minimum, toxic.maximum) == (0.1, 1.0)
    assert (toxic.lower_whisker, toxic.upper_whisker) == (0.1, 0.4)
    assert rows["Non-Toxic"].median == 0.5


def lengths(spark, training, inference):
    rows = [(drift.TRAINING, v) for v in training] + [(drift.INFERENCE, v) for v in inference]
    return spark.createDataFrame(rows, "source string, length int")


def test_length_summary(spark):
    rows = {r.source: r for r in drift.length_summary(lengths(spark, [1, 2, 3, 4], [10, 10])).collect()}
    training = rows[drift.TRAINING]
    assert (training.n, training.mean, training.q1, training.median, training.q3) == (4, 2.5, 1.75, 2.5, 3.25)
    assert training.sd == pytest.approx(math.sqrt(5 / 3)) and rows[drift.INFERENCE].sd == 0.0
    assert rows["Difference"].mean == 7.5 and rows["Difference"].n == -2


def test_density(spark):
    training, inference = [1, 2, 3, 4, 9], [5, 5, 5]
    rows = drift.length_density(lengths(spark, training, inference), steps=8).collect()
    got = {(r.source, r.step): (r.x, r.density) for r in rows}
    assert len(got) == 18
    mean = sum(training) / 5
    sd = math.sqrt(sum((v - mean) ** 2 for v in training) / 4)
    width = 1.06 * min(sd, (4 - 2) / 1.34) * 5 ** -0.2
    for source, values, h in ((drift.TRAINING, training, width), (drift.INFERENCE, inference, 1.0)):
        for step in range(9):
            x = 1 + 8 * step / 8
            want = sum(math.exp(-((x - v) / h) ** 2 / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
            assert got[source, step] == (pytest.approx(x), pytest.approx(want))


def test_drift_sources_and_clip(spark, comments, logs):
    predictions = monitor.parse_predictions(logs)
    rows = drift.length_drift(comments, predictions).collect()
    assert sorted(r.length for r in rows if r.source == drift.INFERENCE) == [0, 1, 2, 4]
    assert sorted(r.length for r in rows if r.source == drift.TRAINING) == [18, 19, 19, 22, 25, 26]
    assert drift.length_drift(comments, predictions, n=2).filter("source = 'Training Data'").count() == 2
    clipped = drift.length_drift(comments, predictions, n=None, clip=10).filter("source = 'Training Data'")
    assert {r.length for r in clipped.collect()} == {13}


def test_dashboard_has_every_panel(spark, comments, logs, items):  # noqa: F811
    panels = dashboard(logs, comments, items, at(spark, "2024-03-03"))
    assert len(panels) == 15
    assert all(panel.columns for panel in panels.values())
    assert panels["daily_toxicity"].count() == 2 and panels["health_alerts"].count() >= 1
