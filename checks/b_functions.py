"""B: projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, shown
from checks.sql import (
    ACTIVITY,
    ANY_PRED,
    BASE,
    COMMENTS,
    FEEDBACK,
    SCORED,
    TOP,
    clean,
    cut,
    listed,
    query,
    title,
)
from checks.sql import shown as shown_sql
from modlytics.functions import labels as lb
from modlytics.functions.text import clean_text, preview, text_length
from modlytics.functions.values import event_date, parse_ts, round_half_even
from modlytics.plans import views
from modlytics.schema import LABELS, pred_cols, prob_cols


@check("b1_clean_text", f"SELECT doc_id, {clean('text')} AS clean_text FROM documents")
def b1(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", clean_text(F.col("text")).alias("clean_text")
    )


@check(
    "b2_text_length",
    "SELECT d.doc_id, length(d.text) AS length, CASE WHEN l.doc_id IS NULL THEN 0 ELSE length(d.text) END AS log_length "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def b2(spark, sf):
    documents = views.table(spark, sf, "documents")
    labels = views.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    text = F.when(F.col("known"), F.col("text"))
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        text_length(F.col("text")).cast("bigint").alias("length"),
        text_length(text, null_as_zero=True).cast("bigint").alias("log_length"),
    )


@check(
    "b3_preview",
    f"""SELECT doc_id, {cut('text')} AS log_preview, substring(text, 1, 20) || '...' AS short_preview,
  substring(text, 1, 100) || '...' AS queue_preview FROM documents""",
)
def b3(spark, sf):
    text = F.col("text")
    return views.table(spark, sf, "documents").select(
        "doc_id",
        preview(text).alias("log_preview"),
        preview(text, 20, always=True).alias("short_preview"),
        preview(text, 100, always=True).alias("queue_preview"),
    )


@check(
    "b4_parse_ts",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN NULL
  WHEN 'view' THEN {shown_sql("date_trunc('milliseconds', ts)")} WHEN 'click' THEN {shown_sql("date_trunc('second', ts)")}
  ELSE {shown_sql('ts')} END AS ts FROM events""",
)
def b4(spark, sf):
    """The written formats, one per event type: milliseconds after a comma, whole seconds,
    microseconds with an offset, and text that is no time."""
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"))
        .when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_type")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    )
    return views.table(spark, sf, "events").select("event_id", shown(parse_ts(text)).alias("ts"))


@check(
    "b5_event_date",
    query([ACTIVITY], "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM activity"),
)
def b5(spark, sf):
    return views.activity(spark, sf).select(
        "event_id", event_date(F.col("ts")).cast("string").alias("date")
    )


@check(
    "b6_label_title",
    query(
        [COMMENTS],
        "SELECT comment_id, label, " + title("label") + " AS title FROM ("
        + listed("SELECT comment_id, '{l}' AS label FROM comments WHERE {l} = 1", " UNION ALL ")
        + ") x",
    ),
)
def b6(spark, sf):
    names = F.array_compact(F.array(*(F.when(F.col(name) == 1, name) for name in LABELS)))
    rows = views.comments(spark, sf).select("comment_id", F.explode(names).alias("label"))
    return rows.withColumn("title", lb.label_title(F.col("label")))


@check(
    "b7_flatten_labels",
    query(
        [SCORED],
        "SELECT comment_id, toxic_pred AS toxic, "
        + listed("coalesce({l}_pred, FALSE) AS {l}_flag")
        + " FROM scored",
    ),
)
def b7(spark, sf):
    """Maps that hold only the set labels, null where none is set."""
    every = lb.label_map(pred_cols())
    some = F.map_filter(every, lambda _, flag: flag)
    rows = views.scored(spark, sf).select(
        "comment_id", F.when(lb.is_any_label(pred_cols()), some).alias("labels")
    )
    return rows.select(
        "comment_id",
        lb.map_get("labels", "toxic", False).alias("toxic"),
        *lb.flatten_labels("labels", "_flag", False),
    )


@check("b8_is_any_label", query([SCORED], f"SELECT comment_id, ({ANY_PRED}) AS is_toxic FROM scored"))
def b8(spark, sf):
    return views.scored(spark, sf).select(
        "comment_id", lb.is_any_label(pred_cols()).alias("is_toxic")
    )


@check(
    "b9_max_label_probability",
    query(
        [SCORED],
        f"SELECT comment_id, {TOP} AS top, greatest("
        + listed("round_even({l}_prob, 2)")
        + ") AS top_rounded FROM scored",
    ),
)
def b9(spark, sf):
    return views.scored(spark, sf).select(
        "comment_id",
        lb.max_label_probability(prob_cols()).alias("top"),
        lb.max_label_probability(prob_cols(), 2).alias("top_rounded"),
    )


@check(
    "b10_round_half_even",
    """SELECT event_id, round_even(value / CAST(1000 AS DOUBLE), 4) AS four, round_even(value / CAST(7 AS DOUBLE), 3) AS three,
  round_even(event_id % 32 / CAST(32 AS DOUBLE), 3) AS ties FROM events""",
)
def b10(spark, sf):
    value = F.col("value")
    return views.table(spark, sf, "events").select(
        "event_id",
        round_half_even(value / F.lit(1000.0), 4).alias("four"),
        round_half_even(value / F.lit(7.0), 3).alias("three"),
        round_half_even(F.col("event_id") % 32 / F.lit(32.0), 3).alias("ties"),
    )


@check(
    "b11_positive_labels",
    query(
        [SCORED],
        "SELECT comment_id, concat_ws(', ', " + listed("CASE WHEN {l}_pred THEN '{l}' END")
        + ") AS labels FROM scored",
    ),
)
def b11(spark, sf):
    rows = views.scored(spark, sf).select("comment_id", lb.label_map(pred_cols()).alias("flags"))
    return rows.select("comment_id", lb.positive_labels("flags").alias("labels"))


@check(
    "b12_invert_labels",
    query([SCORED], "SELECT comment_id, " + listed("NOT {l}_pred AS {l}_true") + " FROM scored"),
)
def b12(spark, sf):
    rows = views.scored(spark, sf).select("comment_id", lb.label_map(pred_cols()).alias("flags"))
    inverted = rows.select("comment_id", lb.invert_labels("flags").alias("labels"))
    return inverted.select("comment_id", *lb.flatten_labels("labels", "_true", False))


@check(
    "b13_labels_equal",
    query(
        BASE + [FEEDBACK],
        "SELECT event_id, is_prediction_correct FROM feedback",
    ),
)
def b13(spark, sf):
    return views.feedback(spark, sf).select(
        "event_id",
        lb.labels_equal("predicted_labels", "true_labels").alias("is_prediction_correct"),
    )
