"""Monitoring reports over prediction and feedback logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.labels import flatten_labels
from modlytics.functions.text import text_length
from modlytics.functions.values import (
    event_date,
    parse_ts,
    percent,
    round_half_even,
    round_half_even_sql,
    rows_of,
)
from modlytics.schema import LABELS


def filter_feedback(logs: DataFrame) -> DataFrame:
    return logs.filter(
        (F.col("endpoint") == "/feedback") & F.col("is_prediction_correct").isNotNull()
    )


def filter_predictions(logs: DataFrame) -> DataFrame:
    """Records of either prediction kind."""
    return logs.filter(F.col("probabilities").isNotNull() | F.col("predictions").isNotNull())


def parse_predictions(logs: DataFrame, null_defaults: bool = False) -> DataFrame:
    """One flat row per prediction record.

    A kind lacks the other kind's fields; they count as 0 and False, or stay null with
    ``null_defaults`` so that averages cover only rows that carry the field.
    """
    zero, no = (None, None) if null_defaults else (0.0, False)
    filled = lambda name, default: F.coalesce(F.col(name), F.lit(default)).alias(name)
    return filter_predictions(logs).select(
        "timestamp",
        "endpoint",
        text_length(F.col("request_text"), null_as_zero=True).alias("text_length"),
        filled("is_toxic", False),
        filled("max_probability", zero),
        "prediction_latency",
        *flatten_labels("probabilities", "_prob", zero),
        *flatten_labels("predictions", "_pred", no),
        parse_ts(F.col("timestamp")).alias("ts"),
    )


def parse_feedback(logs: DataFrame) -> DataFrame:
    """One flat row per feedback record that carries both label maps."""
    rows = filter_feedback(logs).filter(
        F.col("predicted_labels").isNotNull() & F.col("true_labels").isNotNull()
    )
    flat = rows.select(
        "timestamp",
        text_length(F.col("request_text"), null_as_zero=True).alias("text_length"),
        "is_prediction_correct",
        F.coalesce("user_comments", F.lit("")).alias("user_comments"),
        *flatten_labels("predicted_labels", "_predicted", False),
        *flatten_labels("true_labels", "_true", False),
    )
    return flat.withColumns(
        {f"{label}_correct": F.expr(f"{label}_predicted = {label}_true") for label in LABELS}
    )


def _share(flag: str) -> Column:
    """Share of true among the known values; null without rows."""
    return F.try_divide(F.count_if(flag), F.count(flag))


def overview(predictions: DataFrame, feedback: DataFrame, queue: DataFrame) -> DataFrame:
    """The six headline figures in one row.

    Each input gives one row; the rows are stacked and folded, so no join is involved.
    """
    parts = [
        predictions.agg(
            F.count(F.lit(1)).alias("total_predictions"),
            (_share("is_toxic") * 100).alias("toxicity_rate"),
            F.avg("prediction_latency").alias("mean_latency"),
        ),
        feedback.agg(
            F.count(F.lit(1)).alias("total_feedback"),
            (_share("is_prediction_correct") * 100).alias("user_accuracy"),
        ),
        queue.agg(F.count_if(F.col("status") == "pending").alias("pending_reviews")),
    ]
    names = [name for part in parts for name in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.max(name).alias(name) for name in names))


def daily_toxicity(predictions: DataFrame, ts: str = "ts") -> DataFrame:
    """Volume and toxicity per UTC day; rows without a readable time are left out."""
    return (
        predictions.select(event_date(F.col(ts)).alias("date"), "is_toxic")
        .filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            F.count("is_toxic").alias("total"),
            F.count_if("is_toxic").alias("toxic_count"),
            round_half_even(_share("is_toxic"), 3).alias("toxic_rate"),
        )
    )


def latency_series(predictions: DataFrame, ts: str = "ts") -> DataFrame:
    """Latency points in time order.

    The row number as last sort key lets the sort split a moment that holds very many rows.
    """
    return (
        predictions.select(F.col(ts).alias("datetime"), "prediction_latency")
        .dropna()
        .withColumn("_row", F.monotonically_increasing_id())
        .orderBy("datetime", "prediction_latency", "_row")
        .drop("_row")
    )


def _title(label: str) -> str:
    return f"initcap(replace('{label}', '_', ' '))"


def type_frequency(predictions: DataFrame) -> DataFrame:
    """How often each label was predicted, most frequent first."""
    set_ = [f"count_if({label}_pred) AS {label}_set" for label in LABELS]
    known = [f"count({label}_pred) AS {label}_known" for label in LABELS]
    rows = rows_of(
        predictions.agg(*(F.expr(sql) for sql in set_ + known)),
        *(
            {
                "toxicity_type": _title(label),
                "prediction_rate": f"try_divide({label}_set, {label}_known)",
                "count": f"{label}_set",
            }
            for label in LABELS
        ),
    )
    return rows.orderBy(F.desc("prediction_rate"), "toxicity_type")


def type_confidence(predictions: DataFrame) -> DataFrame:
    """Mean probability per label."""
    means = predictions.agg(*(F.expr(f"avg({label}_prob) AS {label}") for label in LABELS))
    return rows_of(
        means, *({"toxicity_type": _title(label), "average_probability": label} for label in LABELS)
    )


def user_accuracy(feedback: DataFrame) -> DataFrame:
    return feedback.agg(_share("is_prediction_correct").alias("user_accuracy"))


def label_performance(feedback: DataFrame, places: int = 3) -> DataFrame:
    """Accuracy, precision, recall and F1 per label with a true positive example."""
    counts = ["count(1) AS n"]
    for label in LABELS:
        guess, true = f"{label}_predicted", f"{label}_true"
        counts += [
            f"count_if({guess} AND {true}) AS {label}_both",
            f"count_if({guess}) AS {label}_guessed",
            f"count_if({true}) AS {label}_given",
            f"count_if({guess} = {true}) AS {label}_right",
        ]
    ratio = lambda top, bottom: round_half_even_sql(
        f"coalesce(try_divide({top}, {bottom}), 0D)", places
    )
    rows = (
        {
            "toxicity_type": _title(label),
            "given": f"{label}_given",
            "accuracy": ratio(f"{label}_right", "n"),
            "precision": ratio(f"{label}_both", f"{label}_guessed"),
            "recall": ratio(f"{label}_both", f"{label}_given"),
            "f1_score": ratio(f"2 * {label}_both", f"({label}_guessed + {label}_given)"),
        }
        for label in LABELS
    )
    table = rows_of(feedback.agg(*(F.expr(sql) for sql in counts)), *rows)
    return table.filter(F.col("given") > 0).drop("given")


def feedback_table(feedback_logs: DataFrame) -> DataFrame:
    """Feedback as given; a label the user did not state stays null."""
    stated = [
        F.expr(f"try_element_at(true_labels, '{label}') AS is_{label}") for label in LABELS
    ]
    return filter_feedback(feedback_logs).select(
        F.coalesce("request_text", F.lit("")).alias("text"), "is_prediction_correct", *stated
    )


def health_alerts(
    predictions: DataFrame, feedback: DataFrame, as_of: Column, ts: str = "ts"
) -> DataFrame:
    """Alert rows (type, severity, message); a check without input rows is silent.

    ``as_of`` takes the place of the clock.
    """
    accuracy = feedback.agg(_share("is_prediction_correct").alias("share"))
    share = F.col("share")
    text = lambda *parts: F.concat(
        *(F.lit(part) if isinstance(part, str) else part for part in parts)
    )
    alert = lambda kind, severity, message: F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message")
    )
    low_accuracy = F.when(
        share < 0.8,
        alert("error", "High",
              text("Overall model accuracy has dropped to ", percent(share), " (below 80% threshold)")),
    ).when(
        share < 0.9,
        alert("warning", "Medium",
              text("Overall model accuracy is ", percent(share), " (below 90% target)")),
    )
    since = as_of - F.make_dt_interval(F.lit(1))
    volume = predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(ts) > since).alias("recent"),
        _share("is_toxic").alias("share"),
    )
    silence = F.when(
        (F.col("rows") > 0) & (F.col("recent") == 0),
        alert("warning", "Medium", F.lit("No predictions made in the last 24 hours")),
    )
    high_rate = F.when(
        share > 0.5,
        alert("warning", "Medium",
              text("High toxicity rate detected: ", percent(share),
                   " of recent comments flagged as toxic")),
    )
    return accuracy.select(F.inline(F.array_compact(F.array(low_accuracy)))).unionByName(
        volume.select(F.inline(F.array_compact(F.array(silence, high_rate))))
    )
