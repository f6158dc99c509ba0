"""F: batch scoring and moderation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import check, shown
from checks.sql import (
    ACTIVITY,
    ANY_PRED,
    BASE,
    CALLS,
    FEEDBACK,
    MODERATED,
    PREDICTIONS,
    PREDS,
    PRIORITY,
    PROBS,
    QUEUE,
    REVIEWED,
    REVIEWS,
    SCORED,
    TOP,
    cut,
    decided,
    iso,
    listed,
    query,
)
from checks.sql import shown as shown_sql
from modlytics.functions.labels import flatten_labels, max_label_probability, positive_labels
from modlytics.operators import moderation, queue
from modlytics.operators.monitor import parse_predictions
from modlytics.operators.records import decision_log, feedback_log, review_log
from modlytics.plans import views
from modlytics.plans.intake import answer_requests, service_log
from modlytics.schema import pred_cols, prob_cols
from modlytics.session import require_folder

PRED_LIST, PROB_LIST = ", ".join(PREDS), ", ".join(PROBS)
QUEUE_CTES = BASE + [MODERATED, QUEUE]
REVIEW_CTES = QUEUE_CTES + [REVIEWS, REVIEWED]
QUEUE_TEXT = f"""queue_id, text, context, user_id, {shown_sql('created_at')} AS created_at, priority, status"""


def queue_rows(items, *more):
    return items.select(
        "queue_id", "text", "context", "user_id", shown(F.col("created_at")).alias("created_at"),
        "priority", "status", *more,
    )


@check("f1_predict", query([SCORED], f"SELECT comment_id, {PRED_LIST}, ({ANY_PRED}) AS is_toxic FROM scored"))
def f1(spark, sf):
    return moderation.predictions(views.scored(spark, sf)).select("comment_id", *pred_cols(), "is_toxic")


@check(
    "f2_predict_proba",
    query(
        [SCORED],
        f"SELECT comment_id, {PRED_LIST}, ({ANY_PRED}) AS is_toxic, "
        + listed("round_even({l}_prob, 4) AS {l}_prob")
        + f", round_even({TOP}, 4) AS max_probability FROM scored",
    ),
)
def f2(spark, sf):
    return moderation.probabilities(views.scored(spark, sf)).select(
        "comment_id", *pred_cols(), "is_toxic", *prob_cols(), "max_probability"
    )


@check(
    "f3_moderation_decision",
    query([SCORED, decided("scored")], "SELECT comment_id, action, confidence, reasoning FROM decided"),
)
def f3(spark, sf):
    return moderation.decide(views.scored(spark, sf)).select(
        "comment_id", "action", "confidence", "reasoning"
    )


@check(
    "f4_moderate",
    query(
        BASE + [MODERATED],
        "SELECT event_id, action, confidence, reasoning, review_required, queue_id FROM moderated",
    ),
)
def f4(spark, sf):
    return views.moderated(spark, sf).select(
        "event_id", "action", "confidence", "reasoning", "review_required", "queue_id"
    )


@check(
    "f5_queue_priority",
    query([SCORED], f"SELECT comment_id, {PRIORITY} AS priority FROM (SELECT *, {TOP} AS top FROM scored) x"),
)
def f5(spark, sf):
    return views.scored(spark, sf).select(
        "comment_id", moderation.queue_priority(max_label_probability(prob_cols())).alias("priority")
    )


@check(
    "f6_enqueue",
    query(
        QUEUE_CTES,
        f"SELECT {QUEUE_TEXT}, concat_ws(', ', " + listed("CASE WHEN {l}_pred THEN '{l}' END")
        + f") AS labels, {PROB_LIST} FROM queue",
    ),
)
def f6(spark, sf):
    return queue_rows(
        views.review_queue(spark, sf),
        positive_labels("toxicity_predictions").alias("labels"),
        *flatten_labels("toxicity_probabilities", "_prob", 0.0),
    )


RANK = "CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END"


@check(
    "f7_list_queue",
    query(
        REVIEW_CTES,
        f"""SELECT {QUEUE_TEXT} FROM reviewed WHERE status = 'pending' ORDER BY {RANK}, reviewed.created_at, queue_id LIMIT 50""",
    ),
)
def f7(spark, sf):
    reviewed = queue.apply_reviews(views.review_queue(spark, sf), views.reviews(spark, sf))
    return queue_rows(queue.list_queue(reviewed))


@check(
    "f8_apply_reviews",
    query(
        REVIEW_CTES,
        f"""SELECT queue_id, status, final_action, moderator_notes, {shown_sql('reviewed_at')} AS reviewed_at, TRUE AS known FROM reviewed
UNION ALL SELECT queue_id, 'unknown', action, moderator_notes, {shown_sql('reviewed_at')}, FALSE FROM reviews
WHERE queue_id NOT IN (SELECT queue_id FROM queue)""",
    ),
)
def f8(spark, sf):
    items, given = views.review_queue(spark, sf), views.reviews(spark, sf)
    at = shown(F.col("reviewed_at")).alias("reviewed_at")
    applied = queue.apply_reviews(items, given).select(
        "queue_id", "status", "final_action", "moderator_notes", at, F.lit(True).alias("known")
    )
    stray = queue.unknown_reviews(items, given).select(
        "queue_id", F.lit("unknown").alias("status"), F.col("action").alias("final_action"),
        "moderator_notes", at, F.lit(False).alias("known"),
    )
    return applied.unionByName(stray)


STATS = """SELECT count(*) AS total_items, count(*) FILTER (status = 'pending') AS pending_items,
  count(*) FILTER (status = 'reviewed') AS reviewed_items,
  count(*) FILTER (status = 'pending' AND priority = 'high') AS high_priority_pending,
  count(*) FILTER (status = 'pending' AND priority = 'medium') AS medium_priority_pending,
  count(*) FILTER (status = 'pending' AND priority = 'low') AS low_priority_pending FROM reviewed"""


@check("f9_queue_stats", query(REVIEW_CTES, STATS))
def f9(spark, sf):
    return queue.queue_stats(
        queue.apply_reviews(views.review_queue(spark, sf), views.reviews(spark, sf))
    )


@check(
    "f10_purge_queue",
    query(
        QUEUE_CTES,
        """SELECT queue_id, (SELECT count(*) FROM queue WHERE created_at < TIMESTAMP '2024-01-20') AS removed
FROM queue WHERE created_at >= TIMESTAMP '2024-01-20'""",
    ),
)
def f10(spark, sf):
    as_of = F.lit("2024-02-19 00:00:00").cast("timestamp")
    kept, removed = queue.purge_queue(views.review_queue(spark, sf), as_of, days=30)
    return kept.select("queue_id", removed.scalar().alias("removed"))


@check(
    "f11_log_records",
    query(
        QUEUE_CTES + [REVIEWS, FEEDBACK],
        f"""SELECT {iso('ts')} AS "timestamp", '/moderate' AS endpoint, {cut('comment_text')} AS request_text, 'forum' AS context,
  CAST(user_id AS VARCHAR) AS user_id, action AS decision, queue_id, NULL AS moderator_notes, NULL AS user_comments,
  NULL AS is_prediction_correct, NULL AS review_action FROM moderated
UNION ALL SELECT {iso('reviewed_at')}, '/moderation-queue/review', NULL, NULL, NULL, NULL, queue_id, moderator_notes, NULL, NULL, action
FROM reviews
UNION ALL SELECT {iso('ts')}, '/feedback', request_text, NULL, NULL, NULL, NULL, NULL, user_comments, is_prediction_correct, NULL
FROM feedback""",
    ),
)
def f11(spark, sf):
    records = (
        decision_log(views.moderated(spark, sf))
        .unionByName(review_log(views.reviews(spark, sf)))
        .unionByName(feedback_log(views.feedback(spark, sf), "comment_text"))
    )
    return records.select(
        "timestamp", "endpoint", "request_text", "context", "user_id", "decision", "queue_id",
        "moderator_notes", "user_comments", "is_prediction_correct", F.col("action").alias("review_action"),
    )


@check(
    "f12_normalize_action",
    query(
        [ACTIVITY],
        """SELECT event_id, CASE endpoint WHEN '/predict' THEN 'approve' WHEN '/predict_proba' THEN 'reject' WHEN '/feedback' THEN 'warn'
  WHEN '/moderate' THEN 'approve' ELSE 'unknown:escalate' END AS action FROM activity""",
    ),
)
def f12(spark, sf):
    """Each call kind speaks one of the vocabularies."""
    word = (
        F.when(F.col("endpoint") == "/predict", "allow")
        .when(F.col("endpoint") == "/predict_proba", "block")
        .when(F.col("endpoint") == "/feedback", "warn")
        .when(F.col("endpoint") == "/moderate", "approve")
        .otherwise("escalate")
    )
    return views.activity(spark, sf).select("event_id", moderation.normalize_action(word).alias("action"))


VALID_CALLS = CALLS[:-1] + " WHERE length(s.comment_text) BETWEEN 1 AND 5000)"


@check(
    "f11_service_log",
    query(
        [SCORED, ACTIVITY, VALID_CALLS, PREDICTIONS],
        f"""SELECT {iso('ts')} AS "timestamp", endpoint, text_length, is_toxic, round_even(max_probability, 4) AS max_probability,
  prediction_latency, {PRED_LIST}, """ + listed("round_even({l}_prob, 4) AS {l}_prob") + " FROM predictions",
    ),
)
def f11_service_log(spark, sf):
    """Both kinds of answers are scored, logged and committed; the reports' rows are read off the stored log."""
    path = f"{require_folder(spark)}/service-{uuid.uuid4().hex}"
    calls = views.calls(spark, sf)
    texts = views.table(spark, sf, "documents").select(F.col("doc_id").alias("comment_id"), F.col("text").alias("comment_text"))
    requests = calls.join(texts, "comment_id").select("comment_id", "ts", "endpoint", "comment_text", "prediction_latency")
    for endpoint, scores in (("/predict", False), ("/predict_proba", True)):
        answer_requests(
            requests.filter(F.col("endpoint") == endpoint), lambda rows: views.with_scores(rows, "comment_id"),
            path, f"kind={endpoint[1:]}", F.col("ts"), scores,
        )
    return parse_predictions(service_log(spark, path)).drop("ts")
