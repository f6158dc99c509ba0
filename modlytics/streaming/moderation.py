"""Moderation on arriving comments, and the review queue kept from two streams.

Every micro-batch writes its own folder, named after the query and the batch.  A batch that is
replayed after a failure therefore meets its own rows and nothing else, and a query that starts
again from a new checkpoint leaves the rows of the earlier one alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.operators.queue import is_expired
from modlytics.plans.moderation import moderate_table
from modlytics.sources.queue_store import append_entries, queue_entries, queue_of, read_entries, unknown_of
from modlytics.streaming.parts import part_name, query_id


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All batches of a table, without the batch column."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)


def stream_moderate(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    created_at: Column,
    checkpoint: str,
    text: str = "comment_text",
    content_key: str = "comment_id",
):
    """Writer for decisions, queue rows, log rows and rejects under ``path``; start it to run.

    A batch is read once and is one part of the four tables; ``read_committed`` shows it when all four are there.
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        part = part_name(batch_rows.sparkSession, checkpoint, batch)
        held = batch_rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            moderate_table(held, score, path, created_at, part, text, content_key)
        finally:
            held.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_queue(items: DataFrame, reviews: DataFrame, path: str, checkpoint: str):
    """Writer that keeps arriving items and reviews in the stored queue under ``path``; start it to run.

    Both streams go through one query, and a batch of it is one part, written in one reading.  A part that is there,
    or that a compaction has folded already, is left as it is.
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        append_entries(batch_rows, path, query_id(batch_rows.sparkSession, checkpoint), batch)

    entries = queue_entries(items, reviews)
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def queue_state(
    spark: SparkSession, path: str, as_of: Column | None = None, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """(queue with reviews applied and old items left out, last reviews of unknown ids).

    An item that arrived more than once is one item, as it arrived first.
    """
    entries = read_entries(spark, path)
    queue = queue_of(entries)
    return queue if as_of is None else queue.filter(~is_expired(as_of, days)), unknown_of(entries)
