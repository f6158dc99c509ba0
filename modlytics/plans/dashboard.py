"""All monitoring panels over one reading of the logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from modlytics.operators import drift, monitor
from modlytics.operators.queue import queue_breakdown, queue_preview
from modlytics.session import keep


def dashboard(
    logs: DataFrame, training_comments: DataFrame, queue: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """Panel name -> DataFrame.  The parsed logs are kept once; every panel reads them."""
    predictions = keep(monitor.parse_predictions(logs))
    feedback = keep(monitor.parse_feedback(logs))
    lengths = drift.length_drift(training_comments, predictions)
    return {
        "overview": monitor.overview(predictions, feedback, queue),
        "length_summary": drift.length_summary(lengths),
        "length_density": drift.length_density(lengths),
        "daily_toxicity": monitor.daily_toxicity(predictions),
        "latency_series": monitor.latency_series(predictions),
        "type_frequency": monitor.type_frequency(predictions),
        "type_confidence": monitor.type_confidence(predictions),
        "user_accuracy": monitor.user_accuracy(feedback),
        "label_performance": monitor.label_performance(feedback),
        "confidence_histogram": drift.confidence_histogram(predictions),
        "confidence_box": drift.confidence_box(predictions),
        "queue_breakdown": queue_breakdown(queue),
        "queue_preview": queue_preview(queue),
        "health_alerts": monitor.health_alerts(predictions, feedback, as_of),
        "feedback_table": monitor.feedback_table(logs),
    }
