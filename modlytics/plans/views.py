"""Comment, score and log tables derived from the given tables.

The given data has texts, one real label and an event stream, but no moderation service
behind it.  These frames stand in for the service's tables; every row comes from a given
row, so they grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.functions.labels import invert_labels_sql, label_map_sql, labels_equal
from modlytics.functions.text import preview
from modlytics.functions.values import iso_utc
from modlytics.operators.moderation import enqueue, moderate, probabilities
from modlytics.operators.records import log_records
from modlytics.schema import pred_cols, prob_cols
from modlytics.session import use_utc

# Which record kind each event type stands for.
ENDPOINTS = {
    "view": "/predict_proba",
    "click": "/predict",
    "purchase": "/feedback",
    "signup": "/moderate",
}
REVIEW_ENDPOINT = "/moderation-queue/review"

# Divisors that make five further labels subsets of the real one.
DERIVED_LABELS = {"severe_toxic": 7, "obscene": 2, "threat": 11, "insult": 3, "identity_hate": 5}

# Factor and offset of each label's stand-in score.
SCORE_TERMS = {
    "toxic": (7919, 11),
    "severe_toxic": (104729, 23),
    "obscene": (1299709, 37),
    "threat": (15485863, 53),
    "insult": (611953, 71),
    "identity_hate": (2750159, 97),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts; texts without a label row are left out."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    derived = [
        f"CASE WHEN toxic = 1 AND doc_id % {divisor} = 0 THEN 1 ELSE 0 END AS {label}"
        for label, divisor in DERIVED_LABELS.items()
    ]
    return documents.join(labels, "doc_id").selectExpr(
        "doc_id AS comment_id", "text AS comment_text", "lang", "source", "toxic", *derived
    )


def with_scores(df: DataFrame, key: str) -> DataFrame:
    """Adds stand-in probabilities with four places, and flags above one half."""
    scores = [
        f"least(10000, floor((({key} * {factor} + {offset}) % 10007) * ({key} % 10) / 9D)) / 10000D AS {label}_prob"
        for label, (factor, offset) in SCORE_TERMS.items()
    ]
    flags = [f"{score} > 0.5D AS {flag}" for flag, score in zip(pred_cols(), prob_cols())]
    return df.selectExpr("*", *scores).selectExpr("*", *flags)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"), F.col("text").alias("comment_text")
    )
    return with_scores(documents, "comment_id")


def truth_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beside the labels, for the metrics."""
    return with_scores(comments(spark, sf_dir), "comment_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service call per event, on a document chosen by the event's number."""
    # Answered from the parquet footers; one number.
    n = table(spark, sf_dir, "documents").count()
    kinds = " ".join(f"WHEN '{event}' THEN '{endpoint}'" for event, endpoint in ENDPOINTS.items())
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "timestamp(ts) AS ts", "user_id", "props", "value",
        f"CASE event_type {kinds} ELSE '{REVIEW_ENDPOINT}' END AS endpoint",
        "value / 1000D AS prediction_latency",
        f"event_id % {n} AS comment_id",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the text they were about, as logged."""
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("comment_id"), preview(F.col("text")).alias("request_text")
    )
    return calls(spark, sf_dir).join(texts, "comment_id")


def scored_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the text and scores of their document.

    The logged start of the text is cut before the join, so that reports which need no
    more than that do not move whole texts.
    """
    texts = scored(spark, sf_dir).withColumn("request_text", preview(F.col("comment_text")))
    joined = calls(spark, sf_dir).join(texts, "comment_id")
    return joined.withColumn("created_at", F.col("ts"))


def moderated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the /moderate calls."""
    made = scored_activity(spark, sf_dir).filter(F.col("endpoint") == "/moderate")
    return moderate(made.withColumn("context", F.lit("forum")), F.col("ts"), "event_id")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enqueue(moderated(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderator decisions: a first and sometimes a second look at queue items, by the
    value of the call, and the /review calls, whose ids the queue does not know."""
    made = scored_activity(spark, sf_dir).filter(
        F.col("endpoint").isin("/moderate", REVIEW_ENDPOINT)
    )
    decided = moderate(made, F.col("ts"), "event_id")
    queued = "endpoint = '/moderate' AND review_required"
    look = (
        "CASE WHEN {when} THEN struct({queue_id} AS queue_id, {action} AS action, "
        "{notes} AS moderator_notes, {at} AS reviewed_at) END"
    )
    looks = [
        look.format(when=f"{queued} AND value >= 5", queue_id="queue_id", notes="'first look'",
                    action="CASE WHEN toxic_pred THEN 'reject' ELSE 'approve' END",
                    at="ts + INTERVAL 1 HOUR"),
        look.format(when=f"{queued} AND value >= 20", queue_id="queue_id", notes="CAST(NULL AS STRING)",
                    action="'warn'", at="ts + INTERVAL 2 HOURS"),
        look.format(when=f"endpoint = '{REVIEW_ENDPOINT}'", queue_id="concat('mod_unknown_', event_id)",
                    notes="'stray'", action="'approve'", at="ts"),
    ]
    return decided.selectExpr(f"array_compact(array({', '.join(looks)})) AS looks").selectExpr(
        "inline(looks)"
    )


def _feedback_fields() -> list[str]:
    """The user confirms the flags, or every fourth time says they are wrong."""
    flags = label_map_sql(pred_cols())
    return [
        f"{flags} AS predicted_labels",
        f"{label_map_sql(prob_cols())} AS predicted_probabilities",
        f"CASE WHEN event_id % 4 = 0 THEN {invert_labels_sql(flags)} ELSE {flags} END AS true_labels",
        "CASE WHEN event_id % 4 = 0 THEN 'User indicated prediction is wrong - labels inverted' "
        "ELSE 'User confirmed prediction is correct' END AS user_comments",
    ]


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback calls."""
    given = scored_activity(spark, sf_dir).filter(F.col("endpoint") == "/feedback")
    return given.selectExpr("event_id", "created_at", "comment_text", *_feedback_fields())


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's log: all five record kinds, told apart by which fields are filled."""
    made = scored_activity(spark, sf_dir).withColumn("context", F.lit("forum"))
    rows = (
        probabilities(moderate(made, F.col("ts"), "event_id"))
        .selectExpr("*", *_feedback_fields())
        .withColumn("correct", labels_equal("predicted_labels", "true_labels"))
    )
    predicted = "endpoint IN ('/predict', '/predict_proba')"
    stray = f"endpoint = '{REVIEW_ENDPOINT}'"
    at = lambda *names: "endpoint IN (" + ", ".join(f"'/{name}'" for name in names) + ")"
    fields = {
        "request_text": (f"NOT {stray}", "request_text"),
        "prediction_latency": (at("predict", "predict_proba", "moderate"), "prediction_latency"),
        "is_toxic": (predicted, "is_toxic"),
        "max_probability": (at("predict_proba"), "max_probability"),
        "predictions": (at("predict"), label_map_sql(pred_cols())),
        "probabilities": (at("predict_proba"), label_map_sql(prob_cols())),
        "predicted_labels": (at("feedback"), "predicted_labels"),
        "predicted_probabilities": (at("feedback"), "predicted_probabilities"),
        "true_labels": (at("feedback"), "true_labels"),
        "is_prediction_correct": (at("feedback"), "correct"),
        "user_comments": (at("feedback"), "user_comments"),
        "context": (at("moderate"), "context"),
        "user_id": (at("moderate"), "user_id"),
        "decision": (at("moderate"), "action"),
        "confidence": (at("moderate"), "confidence"),
        "queue_id": (f"{at('moderate')} OR {stray}",
                     f"CASE WHEN {stray} THEN concat('mod_unknown_', event_id) ELSE queue_id END"),
        "action": (stray, "'approve'"),
        "moderator_notes": (stray, "'stray'"),
    }
    filled = {name: F.expr(f"CASE WHEN {when} THEN {value} END") for name, (when, value) in fields.items()}
    return log_records(rows, {"timestamp": iso_utc(F.col("ts")), "endpoint": F.col("endpoint"), **filled})
