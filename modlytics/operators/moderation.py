"""Moderation rules: from scores to decisions and review priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.labels import (
    is_any_label,
    label_count,
    label_map,
    max_label_probability,
)
from modlytics.functions.values import round_half_even
from modlytics.schema import pred_cols, prob_cols


def decide(scored: DataFrame) -> DataFrame:
    """Adds action, confidence and reasoning to scored rows.

    The largest score and the number of flags decide; the first rule that holds wins:
    at least 0.9 reject, at most 0.1 approve, three flags review, at least 0.3 review,
    else approve.  Both figures are columns of their own, so the rules stay short
    expressions however the scores were made.
    """
    top, count = F.col("_top"), F.col("_count")
    rated = scored.withColumns(
        {"_top": max_label_probability(prob_cols()), "_count": label_count(pred_cols())}
    )
    action = (
        F.when(top >= 0.9, "reject")
        .when(top <= 0.1, "approve")
        .when((count >= 3) | (top >= 0.3), "human_review")
        .otherwise("approve")
    )
    several = (count >= 3) & (top > 0.1) & (top < 0.9)
    finding = (
        F.when(top >= 0.9, "High confidence toxicity detected")
        .when(top <= 0.1, "Low toxicity probability")
        .when(several, "Multiple toxicity categories detected")
        .when(top >= 0.7, "High confidence toxicity requiring review")
        .when(top >= 0.3, "Medium confidence toxicity requiring review")
        .otherwise("Low confidence toxicity")
    )
    evidence = F.when(several, F.concat(F.lit(" ("), count.cast("string"), F.lit(" types)"))).otherwise(
        F.concat(F.lit(" (max: "), F.format_number(top, 2), F.lit(")"))
    )
    confidence = F.when((top < 0.9) & ((top <= 0.1) | ((count < 3) & (top < 0.3))), 1.0 - top)
    return rated.withColumns(
        {
            "action": action,
            "confidence": confidence.otherwise(top),
            "reasoning": F.concat(finding, evidence),
        }
    ).drop("_top", "_count")


def queue_priority(top: Column) -> Column:
    return F.when(top >= 0.8, "high").when(top >= 0.5, "medium").otherwise("low")


def predictions(scored: DataFrame) -> DataFrame:
    """What a prediction answers: six flags and the overall flag."""
    return scored.withColumn("is_toxic", is_any_label(pred_cols()))


def probabilities(scored: DataFrame, places: int = 4) -> DataFrame:
    """As ``predictions``, with scores rounded and the largest rounded score."""
    rounded = predictions(scored).withColumns(
        {name: round_half_even(F.col(name), places) for name in prob_cols()}
    )
    return rounded.withColumn("max_probability", max_label_probability(prob_cols()))


def queue_id(created_at: Column, content_key: Column) -> Column:
    """mod_<time>_<hash>; the same content gets the same id on a rerun.

    The full hash is used: eight hex digits start to collide at some ten thousand items.
    """
    stamp = F.date_format(created_at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit("mod_"), stamp, F.lit("_"), F.md5(content_key.cast("string")))


def moderate(
    scored: DataFrame,
    created_at: Column,
    content_key: str = "comment_id",
) -> DataFrame:
    """Decisions with ``review_required`` and, for review rows, ``queue_id``.

    One pass over scored rows; the queue and the log are projections of the result.
    """
    decided = decide(scored).withColumn("created_at", created_at)
    review = F.col("action") == "human_review"
    return decided.withColumn("review_required", review).withColumn(
        "queue_id", F.when(review, queue_id(F.col("created_at"), F.col(content_key)))
    )


def enqueue(decisions: DataFrame, text: str = "comment_text") -> DataFrame:
    """Queue rows of the decisions that need a human, all pending."""
    optional = lambda name: (
        F.col(name).cast("string") if name in decisions.columns else F.lit(None).cast("string")
    )
    return decisions.filter(F.col("action") == "human_review").select(
        "queue_id",
        F.col(text).alias("text"),
        label_map(pred_cols()).alias("toxicity_predictions"),
        label_map(prob_cols()).alias("toxicity_probabilities"),
        optional("context").alias("context"),
        optional("user_id").alias("user_id"),
        "created_at",
        queue_priority(max_label_probability(prob_cols())).alias("priority"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("final_action"),
        F.lit(None).cast("string").alias("moderator_notes"),
        F.lit(None).cast("timestamp").alias("reviewed_at"),
    )


# The words used for one action in different places.
ACTION_WORDS = {
    "approve": "approve",
    "allow": "approve",
    "reject": "reject",
    "block": "reject",
    "human_review": "human_review",
    "warn": "warn",
}


def normalize_action(action: Column) -> Column:
    """One word per action; an unknown word is kept and marked ``unknown:``."""
    known = F.create_map(*(F.lit(part) for pair in ACTION_WORDS.items() for part in pair))
    return F.coalesce(F.try_element_at(known, action), F.concat(F.lit("unknown:"), action))

