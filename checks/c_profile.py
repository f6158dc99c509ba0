"""C: filters, validation, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, r6
from checks.sql import ACTIVITY, BASE, COMMENTS, SCORED, clean, iso, listed, query
from modlytics.operators import profile
from modlytics.operators.monitor import filter_feedback, filter_predictions
from modlytics.plans import views

LABELLED = "labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@check(
    "c1_null_counts",
    query(
        [LABELLED],
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, count(*) FILTER ({name} IS NULL) AS null_count FROM labelled"
            for name in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
        ),
    ),
)
def c1(spark, sf):
    documents, labels = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    return profile.null_counts(documents.join(labels, "doc_id", "left"))


@check(
    "c2_dataset_shape",
    query([COMMENTS], "SELECT count(*) AS row_count, CAST(10 AS INTEGER) AS column_count FROM comments"),
)
def c2(spark, sf):
    return profile.dataset_shape(views.comments(spark, sf))


STATISTICS = listed(
    "SELECT '{l}' AS label, CAST(sum({l}) AS DOUBLE) / count({l}) AS positive_rate, "
    "CAST(sum({l}) AS BIGINT) AS positive_count, count(*) AS total_count FROM comments",
    " UNION ALL ",
)


@check("c3_label_statistics", query([COMMENTS], STATISTICS))
def c3(spark, sf):
    return profile.label_statistics(views.comments(spark, sf))


@check(
    "c4_validate_training",
    """SELECT count(d.doc_id) AS feature_rows, count(l.doc_id) AS label_rows,
  count(*) FILTER (l.doc_id IS NULL) AS features_without_labels,
  count(*) FILTER (d.doc_id IS NULL) AS labels_without_features, CAST(1 AS INTEGER) AS label_columns
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def c4(spark, sf):
    return profile.validation_report(
        views.table(spark, sf, "documents"), views.table(spark, sf, "labels"), "doc_id"
    )


@check(
    "c5_prepare_dataset",
    query(
        [COMMENTS],
        f"SELECT comment_id, {clean('comment_text')} AS clean_text, concat_ws(',', "
        + listed("{l}") + ") AS labels FROM comments",
    ),
)
def c5(spark, sf):
    return profile.prepare_dataset(views.comments(spark, sf)).select(
        "comment_id", "clean_text", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels")
    )


@check(
    "c5_dataset_profile",
    query(
        [COMMENTS, f"statistics AS ({STATISTICS})"],
        """SELECT 'shape' AS section, 'dataset' AS name, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM comments
UNION ALL SELECT 'shape', 'dataset', 'column_count', 10
UNION ALL SELECT 'label_statistics', label, 'positive_rate', round_even(positive_rate, 6) FROM statistics
UNION ALL SELECT 'label_statistics', label, 'positive_count', positive_count FROM statistics
UNION ALL SELECT 'label_statistics', label, 'total_count', total_count FROM statistics
"""
        + "".join(
            f"UNION ALL SELECT 'missing_values', '{name}', 'null_count', count(*) FILTER ({name} IS NULL) FROM comments\n"
            for name in ("comment_id", "comment_text", "lang", "source", "toxic", "severe_toxic",
                         "obscene", "threat", "insult", "identity_hate")
        ),
    ),
)
def c5_profile(spark, sf):
    return profile.dataset_profile(views.comments(spark, sf)).withColumn("value", r6("value"))


@check(
    "c6_validate_requests",
    query(
        [SCORED],
        """SELECT comment_id, length(text) BETWEEN 1 AND 5000 AND p BETWEEN 0 AND 1 AND text IS NOT NULL AS valid,
  concat_ws(',', CASE WHEN text IS NULL THEN 'text_missing' END, CASE WHEN length(text) < 1 THEN 'text_too_short' END,
    CASE WHEN length(text) > 5000 THEN 'text_too_long' END,
    CASE WHEN p NOT BETWEEN 0 AND 1 THEN 'probability_out_of_range' END) AS reasons
FROM (SELECT comment_id, trim(comment_text) AS text, toxic_prob * CAST(1.2 AS DOUBLE) - CAST(0.1 AS DOUBLE) AS p FROM scored) x""",
    ),
)
def c6(spark, sf):
    """Stretched scores, so that some fall outside [0, 1]."""
    requests = views.scored(spark, sf).select(
        "comment_id",
        F.trim("comment_text").alias("text"),
        (F.col("toxic_prob") * 1.2 - 0.1).alias("probability"),
    )
    checked = profile.validate_requests(requests, shares=("probability",))
    return checked.select("comment_id", "valid", F.array_join("reasons", ",").alias("reasons"))


@check(
    "c7_filter_feedback",
    query(
        [ACTIVITY],
        f"""SELECT {iso('ts')} AS "timestamp", endpoint, request_text, event_id % 4 <> 0 AS is_prediction_correct
FROM activity WHERE endpoint = '/feedback'""",
    ),
)
def c7(spark, sf):
    return filter_feedback(views.logs(spark, sf)).select(
        "timestamp", "endpoint", "request_text", "is_prediction_correct"
    )


@check(
    "c8_filter_predictions",
    query(
        BASE,
        f"""SELECT {iso('ts')} AS "timestamp", endpoint, request_text FROM calls
WHERE endpoint IN ('/predict', '/predict_proba')""",
    ),
)
def c8(spark, sf):
    return filter_predictions(views.logs(spark, sf)).select("timestamp", "endpoint", "request_text")
