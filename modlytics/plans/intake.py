"""What the service takes in, written as its log: answers, feedback and reviews.

Every call writes one part of each of its tables and commits the part last, as ``moderate_table`` does: readers
(``read_committed``) see all tables of a part or none, and a part that is committed is left as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.operators.moderation import ACTION_WORDS, normalize_action, predictions, probabilities
from modlytics.operators.profile import validate_requests
from modlytics.operators.records import feedback_log, prediction_log, probability_log, review_log
from modlytics.plans.moderation import commit_path, read_committed
from modlytics.sources.files import exists, put_once
from modlytics.sources.logs import log_items, read_log_items, write_log

FEEDBACK_FIELDS = ("predicted_labels", "predicted_probabilities", "true_labels")


def write_part(path: str, part: str, log: DataFrame, **tables: DataFrame) -> bool:
    """Write log records (as dated items) and further tables as one part; False if it is there already."""
    spark = log.sparkSession
    if exists(spark, commit_path(path, part)):
        return False
    write_log(log_items(log, F.to_timestamp("timestamp")), f"{path}/log/{part}", mode="overwrite")
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/{part}")
    return put_once(spark, commit_path(path, part), json.dumps({"part": part, "tables": ["log", *tables]}))


def answer_requests(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    part: str,
    created_at: Column,
    scores: bool = False,
    text: str = "comment_text",
) -> bool:
    """Flags (or with ``scores`` probabilities) of valid requests under ``answers``, their log, and ``rejected``.

    Requests are scored once: the log is read off the written answers.
    """
    spark = requests.sparkSession
    if exists(spark, commit_path(path, part)):
        return False
    checked = validate_requests(requests, text)
    valid = checked.filter("valid").drop("valid", "reasons").withColumn("created_at", created_at)
    made = probabilities(score(valid)) if scores else predictions(score(valid))
    made.write.mode("overwrite").parquet(f"{path}/answers/{part}")
    written = spark.read.schema(made.schema).parquet(f"{path}/answers/{part}")
    record = probability_log if scores else prediction_log
    return write_part(path, part, record(written, text), rejected=checked.filter("NOT valid"))


def take_feedback(feedback: DataFrame, path: str, part: str) -> bool:
    """Log of feedback that carries its text and all label maps; the rest goes to ``rejected`` with reasons.

    A user may correct a text of any length, as the answer it is about was logged cut.
    """
    missing = [F.when(F.col(name).isNull(), F.lit(f"{name}_missing")) for name in ("request_text", *FEEDBACK_FIELDS)]
    checked = feedback.withColumn("reasons", F.array_compact(F.array(*missing)))
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    return write_part(path, part, feedback_log(good), rejected=checked.filter(F.size("reasons") > 0))


def take_reviews(reviews: DataFrame, path: str, part: str) -> bool:
    """Log of reviews, their rows under ``reviews`` with one word per action, and ``rejected`` without id or known action.

    ``append_entries(queue_entries(reviews=...))`` brings the committed reviews into the stored queue.
    """
    word = normalize_action(F.col("action"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("queue_id").isNull(), F.lit("queue_id_missing")),
            F.when(F.col("action").isNull(), F.lit("action_missing")),
            F.when(~F.col("action").isin(*ACTION_WORDS), F.lit("action_unknown")),
        )
    )
    checked = reviews.withColumn("reasons", reasons)
    good = checked.filter(F.size("reasons") == 0).drop("reasons").withColumn("action", word)
    return write_part(path, part, review_log(good), reviews=good, rejected=checked.filter(F.size("reasons") > 0))


def service_log(spark: SparkSession, path: str) -> DataFrame:
    """All committed log records, as the monitoring reports read them."""
    return read_log_items(read_committed(spark, path, "log"))
