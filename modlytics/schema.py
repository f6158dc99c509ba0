"""Labels, table schemas and column-name rules shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The six labels, in the order every table uses.
LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")

LABEL_FLAGS = T.MapType(T.StringType(), T.BooleanType())
LABEL_SCORES = T.MapType(T.StringType(), T.DoubleType())

COMMENT_SCHEMA = T.StructType(
    [T.StructField("comment_id", T.StringType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(label, T.IntegerType()) for label in LABELS]
)

# One permissive schema for all log record kinds; a kind fills the fields it has.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("request_text", T.StringType()),
        T.StructField("prediction_latency", T.DoubleType()),
        T.StructField("is_toxic", T.BooleanType()),
        T.StructField("max_probability", T.DoubleType()),
        T.StructField("predictions", LABEL_FLAGS),
        T.StructField("probabilities", LABEL_SCORES),
        T.StructField("predicted_labels", LABEL_FLAGS),
        T.StructField("predicted_probabilities", LABEL_SCORES),
        T.StructField("true_labels", LABEL_FLAGS),
        T.StructField("is_prediction_correct", T.BooleanType()),
        T.StructField("user_comments", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("queue_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("moderator_notes", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("pathname", T.StringType()),
        T.StructField("log_date", T.StringType()),
    ]
)

QUEUE_SCHEMA = T.StructType(
    [
        T.StructField("queue_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("toxicity_predictions", LABEL_FLAGS),
        T.StructField("toxicity_probabilities", LABEL_SCORES),
        T.StructField("context", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("priority", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("final_action", T.StringType()),
        T.StructField("moderator_notes", T.StringType()),
        T.StructField("reviewed_at", T.TimestampType()),
    ]
)

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("queue_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("moderator_notes", T.StringType()),
        T.StructField("reviewed_at", T.TimestampType()),
    ]
)


def prob_cols(labels=LABELS) -> list[str]:
    return [f"{label}_prob" for label in labels]


def pred_cols(labels=LABELS) -> list[str]:
    return [f"{label}_pred" for label in labels]
