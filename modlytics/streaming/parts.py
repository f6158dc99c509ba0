"""Folders of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a streaming query, as its checkpoint holds it."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def part_name(spark: SparkSession, checkpoint: str, batch: int) -> str:
    """A name for a batch that no other query has: the query's id and the batch's."""
    return f"query={query_id(spark, checkpoint)}/batch={batch}"


def write_batch(df: DataFrame, path: str, part: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{part}")
