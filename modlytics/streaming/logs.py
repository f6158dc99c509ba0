"""Logs as streams: incremental reading and removal of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlytics.sources.logs import content_hash, event_time, parse_log_lines, split_log_lines
from modlytics.sources.tail import tail_lines
from modlytics.streaming.parts import part_name, write_batch

# Wrapped items as ``write_log`` lays them out.
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("partition_key", T.StringType()),
        T.StructField("sort_key", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("log_date", T.StringType()),
    ]
)


def stream_logs(
    spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """New records of a growing log, with ``ts``; ``stream_log_tables`` keeps the broken lines as well.

    ``json`` follows text files of JSON lines as they grow and rotate, ``parquet`` reads the dated item table.
    """
    return event_time(split_log_lines(stream_parsed(spark, path, format, files_per_batch))[0])


def stream_parsed(
    spark: SparkSession, path: str, format: str = "json", files_per_batch: int | None = None
) -> DataFrame:
    """All lines of a growing log, parsed; ``_corrupt_record`` holds those that are broken.

    ``json`` follows a folder of logs, or one log with its rotated files, line by line: what is appended arrives, and
    a line that is half written does once its end is there (``tail_lines``).  With ``files_per_batch`` each file is
    read once, as a whole, which suits logs that are closed when they are delivered.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if format == "json":
        return parse_log_lines(reader.text(path) if files_per_batch else tail_lines(spark, path))
    items = reader.schema(ITEM_SCHEMA).parquet(path)
    return parse_log_lines(items.filter(F.col("data").isNotNull()), "data")


def stream_log_tables(parsed: DataFrame, path: str, checkpoint: str):
    """Writer for ``stream_parsed``: ``<path>/records`` and, for broken lines, ``<path>/broken``; start it to run.

    Both tables are written from one reading of a batch, which is replaced as a whole on a replay.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = part_name(batch.sparkSession, checkpoint, number)
        good, bad = split_log_lines(batch)
        write_batch(event_time(good), f"{path}/records", part)
        write_batch(bad, f"{path}/broken", part)

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dedupe_log(logs: DataFrame, ts: str = "ts", watermark: str = "1 hour", shards: int = 32) -> DataFrame:
    """Each record once, also when the second copy comes later within the watermark.

    On a batch frame the same rule over all rows.  A stream drops copies twice: first among the rows of tasks that
    share a shard, so that a record which is a large part of the input is spread over the shards, then the
    at most ``shards`` copies that are left.  Both steps remember every record for the watermark's time.
    """
    columns = [name for name in logs.columns if name not in (ts, "log_source")]
    marked = logs.withColumn("_hash", content_hash(logs.select(*columns)))
    keys = ["endpoint", "timestamp", "_hash"]
    if logs.isStreaming:
        placed = marked.withWatermark(ts, watermark).withColumn("_shard", F.pmod(F.spark_partition_id(), F.lit(shards)))
        once = placed.dropDuplicatesWithinWatermark([*keys, "_shard"]).drop("_shard").dropDuplicatesWithinWatermark(keys)
    else:
        once = marked.dropDuplicates(keys)
    return once.drop("_hash")
