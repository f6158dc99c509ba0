"""The human-review queue as a table keyed by queue_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlytics.functions.text import preview
from modlytics.functions.values import rows_of


def _priority_order() -> Column:
    return F.when(F.col("priority") == "high", 0).when(F.col("priority") == "low", 2).otherwise(1)


def list_queue(
    queue: DataFrame,
    status: str = "pending",
    priority: str | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Items by priority, then age.  ``status='all'`` and an empty priority do not filter."""
    items = queue
    if status != "all":
        items = items.filter(F.col("status") == status)
    if priority:
        items = items.filter(F.col("priority") == priority)
    items = items.orderBy(_priority_order(), F.col("created_at").asc_nulls_first(), "queue_id")
    return items.limit(limit) if limit else items


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of every id; reviews of one id are folded before the shuffle."""
    fields = ["action", "moderator_notes", "reviewed_at"]
    last = F.max_by(F.struct(*fields), F.struct("reviewed_at", "action", "moderator_notes"))
    return reviews.groupBy("queue_id").agg(last.alias("last")).select("queue_id", "last.*")


def apply_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """The queue with every item's last review written in; a re-review is allowed."""
    last = latest_reviews(reviews).select(
        "queue_id",
        F.lit(True).alias("_hit"),
        F.col("action").alias("_action"),
        F.col("moderator_notes").alias("_notes"),
        F.col("reviewed_at").alias("_at"),
    )
    hit = F.col("_hit").isNotNull()
    changed = {
        "status": F.when(hit, F.lit("reviewed")).otherwise(F.col("status")),
        "final_action": F.when(hit, F.col("_action")).otherwise(F.col("final_action")),
        "moderator_notes": F.when(hit, F.col("_notes")).otherwise(F.col("moderator_notes")),
        "reviewed_at": F.when(hit, F.col("_at")).otherwise(F.col("reviewed_at")),
    }
    return queue.join(last, "queue_id", "left").withColumns(changed).select(*queue.columns)


def unknown_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews of ids the queue does not hold."""
    return reviews.join(queue.select("queue_id"), "queue_id", "left_anti")


def queue_stats(queue: DataFrame) -> DataFrame:
    """Totals, and priorities among the pending, in one pass."""
    pending = F.col("status") == "pending"
    with_priority = lambda name: F.count_if(pending & (F.col("priority") == name))
    return queue.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(pending).alias("pending_items"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed_items"),
        with_priority("high").alias("high_priority_pending"),
        with_priority("medium").alias("medium_priority_pending"),
        with_priority("low").alias("low_priority_pending"),
    )


def is_expired(as_of: Column, days: int = 30, created: Column | None = None) -> Column:
    """Created before the cut-off; a missing time counts as old."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    return F.coalesce((F.col("created_at") if created is None else created) < cutoff, F.lit(True))


def purge_queue(queue: DataFrame, as_of: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept items, one row with the number removed)."""
    old = is_expired(as_of, days)
    return queue.filter(~old), queue.agg(F.count_if(old).alias("removed"))


def queue_breakdown(queue: DataFrame) -> DataFrame:
    """Status split and pending items per priority as (section, name, items)."""
    stats = queue_stats(queue)
    sections = [
        ("status", "Pending", "pending_items"),
        ("status", "Reviewed", "reviewed_items"),
        ("priority", "High", "high_priority_pending"),
        ("priority", "Medium", "medium_priority_pending"),
        ("priority", "Low", "low_priority_pending"),
    ]
    return rows_of(
        stats,
        *(
            {"section": f"'{section}'", "name": f"'{name}'", "items": column}
            for section, name, column in sections
        ),
    )


def queue_preview(queue: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` pending items in review order, shortened for display."""
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return list_queue(queue, limit=n).select(
        preview(F.col("queue_id"), 20, always=True).alias("queue_id"),
        preview(F.coalesce(F.col("text"), F.lit("")), 100, always=True).alias("text_preview"),
        F.coalesce("priority", F.lit("medium")).alias("priority"),
        F.coalesce(created, F.lit("Unknown")).alias("created"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )
