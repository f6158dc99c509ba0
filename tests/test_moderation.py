from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from modlytics.operators import moderation, queue
from modlytics.operators.records import decision_log, feedback_log, log_records, review_log
from modlytics.schema import LABELS, LOG_SCHEMA, pred_cols, prob_cols
from tests.conftest import INSULT, at, scored_frame


def test_reference_cases(scored):
    rows = {r.comment_id: r for r in moderation.decide(scored).collect()}
    assert (rows["a"].action, rows["a"].confidence) == ("human_review", 0.8)
    assert rows["a"].reasoning == "High confidence toxicity requiring review (max: 0.80)"
    assert (rows["b"].action, rows["b"].confidence) == ("approve", 0.9)
    assert rows["b"].reasoning == "Low toxicity probability (max: 0.10)"
    assert (rows["c"].action, rows["c"].confidence) == ("reject", 0.95)
    assert rows["c"].reasoning == "High confidence toxicity detected (max: 0.95)"


@pytest.mark.parametrize(
    "top, flags, action, start",
    [
        (0.9, 0, "reject", "High confidence toxicity detected (max: 0.90)"),
        (0.9, 3, "reject", "High confidence toxicity detected"),
        (0.1, 3, "approve", "Low toxicity probability (max: 0.10)"),
        (0.2, 0, "approve", "Low confidence toxicity (max: 0.20)"),
        (0.2, 3, "human_review", "Multiple toxicity categories detected (3 types)"),
        (0.8, 3, "human_review", "Multiple toxicity categories detected (3 types)"),
        (0.8, 2, "human_review", "High confidence toxicity requiring review"),
        (0.7, 0, "human_review", "High confidence toxicity requiring review (max: 0.70)"),
        (0.6999, 0, "human_review", "Medium confidence toxicity requiring review"),
        (0.3, 2, "human_review", "Medium confidence toxicity requiring review (max: 0.30)"),
        (0.2999, 2, "approve", "Low confidence toxicity (max: 0.30)"),
    ],
)
def test_rule_edges(spark, top, flags, action, start):
    row = (("k", "t", (top, 0.0, 0.0, 0.0, 0.0, 0.0), tuple(int(i < flags) for i in range(6))),)
    out = moderation.decide(scored_frame(spark, row)).first()
    assert out.action == action and out.reasoning.startswith(start)
    assert out.confidence == (1 - top if action == "approve" else top)


def test_priority_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.8, 0.7999, 0.5, 0.4999)], "p double")
    got = [r.q for r in df.select(moderation.queue_priority(F.col("p")).alias("q")).collect()]
    assert got == ["high", "medium", "medium", "low"]


def test_predictions_and_probabilities(spark):
    df = scored_frame(spark, [("k", "t", (0.82345, 0.1, 0.05, 0.02, 0.71239, 0.01), INSULT[1])])
    row = moderation.probabilities(df).first()
    assert row.is_toxic and row.toxic_prob == 0.8234 and row.max_probability == 0.8234
    assert row.insult_prob == 0.7124


def queued(spark, scored):
    made = moderation.moderate(scored.withColumn("user_id", F.lit("u")), at(spark, "2024-03-01 10:00:00"))
    return made, moderation.enqueue(made)


def test_queue_rows_repeat_their_ids(spark, scored):
    made, items = queued(spark, scored)
    again = queued(spark, scored.repartition(3))[1]
    assert [r.queue_id for r in items.collect()] == [r.queue_id for r in again.collect()]
    row = items.first()
    assert row.queue_id.startswith("mod_20240301_100000_") and row.status == "pending"
    assert row.priority == "high" and row.user_id == "u" and row.context is None
    assert row.toxicity_predictions["insult"] is True and row.toxicity_probabilities["toxic"] == 0.8
    flags = {r.comment_id: (r.review_required, r.queue_id is not None) for r in made.collect()}
    assert flags == {"a": (True, True), "b": (False, False), "c": (False, False)}


QUEUE = [
    ("q1", "low", "2024-01-01 00:00:00", "pending"),
    ("q2", "high", "2024-01-03 00:00:00", "pending"),
    ("q3", "high", "2024-01-02 00:00:00", "pending"),
    ("q4", "odd", "2024-01-01 00:00:00", "pending"),
    ("q5", "medium", "2024-01-05 00:00:00", "pending"),
    ("q6", "high", None, "reviewed"),
]


@pytest.fixture
def items(spark):
    df = spark.createDataFrame(QUEUE, "queue_id string, priority string, c string, status string")
    return df.select(
        "queue_id", F.concat(F.lit("text of "), "queue_id").alias("text"),
        F.col("c").cast("timestamp").alias("created_at"), "priority", "status",
        *(F.lit(None).cast("string").alias(n) for n in ("final_action", "moderator_notes")),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


def test_list_queue(items):
    ids = lambda **kw: [r.queue_id for r in queue.list_queue(items, **kw).collect()]
    assert ids() == ["q3", "q2", "q4", "q5", "q1"]
    assert ids(status="all") == ["q6", "q3", "q2", "q4", "q5", "q1"]
    assert ids(priority="high") == ["q3", "q2"] and ids(priority="") == ids()
    assert ids(limit=2) == ["q3", "q2"] and ids(limit=0) == ids() and ids(limit=None) == ids()


def test_reviews(spark, items):
    reviews = spark.createDataFrame(
        [
            ("q1", "approve", "first", "2024-02-01 00:00:00"),
            ("q1", "reject", None, "2024-02-02 00:00:00"),
            ("q6", "warn", "again", "2024-02-01 00:00:00"),
            ("lost", "approve", "?", "2024-02-01 00:00:00"),
        ],
        "queue_id string, action string, moderator_notes string, r string",
    ).select("queue_id", "action", "moderator_notes", F.col("r").cast("timestamp").alias("reviewed_at"))
    out = {r.queue_id: r for r in queue.apply_reviews(items, reviews).collect()}
    assert len(out) == 6
    assert (out["q1"].status, out["q1"].final_action, out["q1"].moderator_notes) == ("reviewed", "reject", None)
    assert out["q6"].final_action == "warn" and out["q2"].status == "pending"
    assert [r.queue_id for r in queue.unknown_reviews(items, reviews).collect()] == ["lost"]
    stats = queue.queue_stats(queue.apply_reviews(items, reviews)).first().asDict()
    assert stats == {
        "total_items": 6, "pending_items": 4, "reviewed_items": 2, "high_priority_pending": 2,
        "medium_priority_pending": 1, "low_priority_pending": 0,
    }


def test_purge_is_strict_and_counts_missing_times_as_old(spark, items):
    kept, removed = queue.purge_queue(items, at(spark, "2024-02-01 00:00:00"), days=30)
    assert sorted(r.queue_id for r in kept.collect()) == ["q2", "q3", "q5"]
    assert removed.first().removed == 3
    assert queue.purge_queue(items, at(spark, "2024-01-31 00:00:00"), days=30)[1].first().removed == 1


def test_breakdown_and_preview(items):
    rows = {(r.section, r.name): r["items"] for r in queue.queue_breakdown(items).collect()}
    assert rows == {("status", "Pending"): 5, ("status", "Reviewed"): 1, ("priority", "High"): 2,
                    ("priority", "Medium"): 1, ("priority", "Low"): 1}
    first = queue.queue_preview(items, 1).first()
    assert (first.queue_id, first.text_preview) == ("q3...", "text of q3...")
    assert first.created == "2024-01-02T00:00:00"


def test_actions_have_one_vocabulary(spark):
    words = ["approve", "allow", "reject", "block", "human_review", "warn", "escalate", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.a for r in df.select(moderation.normalize_action(F.col("w")).alias("a")).collect()]
    assert got == ["approve", "approve", "reject", "reject", "human_review", "warn", "unknown:escalate", None]


def test_log_records(spark, scored):
    made, _ = queued(spark, scored)
    rows = {r.decision: r for r in decision_log(made).collect()}
    assert rows["human_review"].timestamp == "2024-03-01T10:00:00.000000+00:00"
    assert rows["approve"].queue_id is None and rows["approve"].endpoint == "/moderate"
    assert decision_log(made).columns == LOG_SCHEMA.fieldNames()
    review = spark.createDataFrame([("123", "approve", "Looks fine.")], "queue_id string, action string, moderator_notes string")
    row = review_log(review.withColumn("reviewed_at", at(spark, "2024-03-01"))).first()
    assert (row.endpoint, row.queue_id, row.action) == ("/moderation-queue/review", "123", "approve")
    with pytest.raises(ValueError, match="Not log fields"):
        log_records(made, {"nonsense": F.lit(1)})


def test_feedback_record(spark):
    flags = {label: label in ("toxic", "insult") for label in LABELS}
    probs = dict(zip(LABELS, (0.8234, 0.1245, 0.0892, 0.0156, 0.7123, 0.0234)))
    df = spark.createDataFrame(
        [("You are such an idiot!", flags, probs, flags, "The prediction was accurate.")],
        "request_text string, predicted_labels map<string,boolean>, predicted_probabilities map<string,double>, "
        "true_labels map<string,boolean>, user_comments string",
    ).withColumn("created_at", at(spark, "2024-03-01"))
    row = feedback_log(df).first()
    assert row.is_prediction_correct is True and row.request_text == "You are such an idiot!"
    assert row.predicted_probabilities == probs


def test_moderation_needs_no_python(scored):
    plan = moderation.decide(scored)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert set(pred_cols() + prob_cols()) <= set(scored.columns)
