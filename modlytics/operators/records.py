"""Log records of the service, in the superset log schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.labels import label_map, labels_equal
from modlytics.functions.text import preview
from modlytics.functions.values import iso_utc
from modlytics.schema import LOG_SCHEMA, pred_cols, prob_cols


def log_records(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Rows in the log schema: the given fields, null for the rest."""
    unknown = set(fields) - set(LOG_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"Not log fields: {sorted(unknown)}")
    return df.select(
        *(
            fields[field.name].cast(field.dataType).alias(field.name)
            if field.name in fields
            else F.expr(f"CAST(NULL AS {field.dataType.simpleString()}) AS {field.name}")
            for field in LOG_SCHEMA
        )
    )


def prediction_log(scored: DataFrame, text: str = "comment_text", ts: str = "created_at") -> DataFrame:
    """/predict records; ``scored`` carries is_toxic (see ``predictions``)."""
    return log_records(
        scored,
        {
            "timestamp": iso_utc(F.col(ts)),
            "endpoint": F.lit("/predict"),
            "request_text": preview(F.col(text)),
            "prediction_latency": _optional(scored, "prediction_latency"),
            "is_toxic": F.col("is_toxic"),
            "predictions": label_map(pred_cols()),
        },
    )


def probability_log(scored: DataFrame, text: str = "comment_text", ts: str = "created_at") -> DataFrame:
    """/predict_proba records; ``scored`` carries max_probability (see ``probabilities``)."""
    return log_records(
        scored,
        {
            "timestamp": iso_utc(F.col(ts)),
            "endpoint": F.lit("/predict_proba"),
            "request_text": preview(F.col(text)),
            "prediction_latency": _optional(scored, "prediction_latency"),
            "is_toxic": F.col("is_toxic"),
            "max_probability": F.col("max_probability"),
            "probabilities": label_map(prob_cols()),
        },
    )


def decision_log(decisions: DataFrame, text: str = "comment_text") -> DataFrame:
    """/moderate records."""
    return log_records(
        decisions,
        {
            "timestamp": iso_utc(F.col("created_at")),
            "endpoint": F.lit("/moderate"),
            "request_text": preview(F.col(text)),
            "context": _optional(decisions, "context"),
            "user_id": _optional(decisions, "user_id"),
            "decision": F.col("action"),
            "confidence": F.col("confidence"),
            "queue_id": F.col("queue_id"),
            "prediction_latency": _optional(decisions, "prediction_latency"),
        },
    )


def review_log(reviews: DataFrame) -> DataFrame:
    """/moderation-queue/review records."""
    return log_records(
        reviews,
        {
            "timestamp": iso_utc(F.col("reviewed_at")),
            "endpoint": F.lit("/moderation-queue/review"),
            "queue_id": F.col("queue_id"),
            "action": F.col("action"),
            "moderator_notes": F.col("moderator_notes"),
        },
    )


def feedback_log(feedback: DataFrame, text: str = "request_text", ts: str = "created_at") -> DataFrame:
    """/feedback records; correct means the two label maps agree."""
    return log_records(
        feedback,
        {
            "timestamp": iso_utc(F.col(ts)),
            "endpoint": F.lit("/feedback"),
            "request_text": preview(F.col(text)),
            "predicted_labels": F.col("predicted_labels"),
            "predicted_probabilities": F.col("predicted_probabilities"),
            "true_labels": F.col("true_labels"),
            "is_prediction_correct": labels_equal("predicted_labels", "true_labels"),
            "user_comments": _optional(feedback, "user_comments"),
        },
    )


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
