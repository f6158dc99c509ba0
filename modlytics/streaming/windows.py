"""Windowed monitoring figures, the same code for batch and streaming frames."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from modlytics.functions.values import round_half_even
from modlytics.sources.files import exists, matching, put_once, read_small
from modlytics.streaming.parts import part_name, query_id, write_batch

SLOT_TYPE = "slot bigint, first_ts timestamp, last_ts timestamp, rows bigint"


def _window(ts: str, window: str, slide: str | None) -> Column:
    return F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)


def stream_toxicity(
    predictions: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
    ts: str = "ts",
) -> DataFrame:
    """Volume and toxicity per event-time window.

    On a stream, rows later than the watermark are dropped; ``LateRows`` counts them, folded, and
    ``stream_toxicity_table`` keeps them.
    """
    return (
        predictions.withWatermark(ts, watermark)
        .groupBy(_window(ts, window, slide).alias("w"))
        .agg(F.count("is_toxic").alias("total"), F.count_if("is_toxic").alias("toxic_count"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "total",
            "toxic_count",
            round_half_even(F.try_divide("toxic_count", "total"), 3).alias("toxic_rate"),
        )
    )


def _reached(spark: SparkSession, path: str, query: str, batch: int) -> int | None:
    """The greatest event time, in microseconds, of a query's batches before this one."""
    found = matching(spark, f"{path}/progress/query={query}/batch=*.json")
    earlier = [n for n in (int(name.rsplit("=", 1)[1].removesuffix(".json")) for name in found) if n < batch]
    if not earlier:
        return None
    return json.loads(read_small(spark, f"{path}/progress/query={query}/batch={max(earlier)}.json"))["reached"]


def stream_toxicity_table(
    predictions: DataFrame,
    path: str,
    checkpoint: str,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
    ts: str = "ts",
):
    """Writer that keeps window sums under ``path`` and late rows beside them; start it to run.

    A window is closed once the batches before have reached its end and ``watermark`` more.  What arrives for a closed
    window changes no sum: its rows go to ``late``, whole, with the window they missed.  Open windows
    are summed per batch, and ``stored_toxicity`` adds the batches up, so no state is kept.  A batch shows when both
    tables hold it, and a replay of one that shows changes nothing.  Rows without a time are left out.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        query = query_id(spark, checkpoint)
        done, part = f"{path}/progress/query={query}/batch={batch}.json", f"query={query}/batch={batch}"
        if exists(spark, done):
            return
        before = _reached(spark, path, query, batch)
        held = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            placed = held.withColumn("w", _window(ts, window, slide))
            limit = F.timestamp_micros(F.lit(before)) - F.expr(f"INTERVAL '{watermark}'")
            closed = F.lit(False) if before is None else F.col("w.end") <= limit
            edges = [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]
            late = placed.filter(closed).select("*", *edges).drop("w")
            sums = placed.filter(~closed).groupBy(*edges).agg(
                F.count("is_toxic").alias("total"), F.count_if("is_toxic").alias("toxic_count")
            )
            write_batch(sums, f"{path}/windows", part)
            write_batch(late, f"{path}/late", part)
            here = held.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
            put_once(spark, done, json.dumps({"reached": max((t for t in (before, here) if t is not None), default=None)}))
        finally:
            held.unpersist()

    return predictions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _shown_batches(spark: SparkSession, path: str, table: str) -> DataFrame:
    done = matching(spark, f"{path}/progress/query=*/batch=*.json")
    parts = ["/".join(name.removesuffix(".json").rsplit("/", 2)[1:]) for name in done]
    if not parts:
        raise FileNotFoundError(f"{path} holds no finished batch")
    return spark.read.parquet(*(f"{path}/{table}/{part}" for part in parts))


def stored_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """Volume and toxicity per window of all that ``stream_toxicity_table`` has kept."""
    sums = _shown_batches(spark, path, "windows").groupBy("window_start", "window_end").agg(
        F.sum("total").alias("total"), F.sum("toxic_count").alias("toxic_count")
    )
    return sums.withColumn("toxic_rate", round_half_even(F.try_divide("toxic_count", "total"), 3))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row that came after its window was closed, with that window."""
    return _shown_batches(spark, path, "late")


def stream_latency(
    predictions: DataFrame, window: str = "1 hour", watermark: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """Number, mean and maximum latency per window and endpoint."""
    return (
        predictions.filter(F.col("prediction_latency").isNotNull())
        .withWatermark(ts, watermark)
        .groupBy(_window(ts, window, None).alias("w"), "endpoint")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.avg("prediction_latency").alias("mean_latency"),
            F.max("prediction_latency").alias("max_latency"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "endpoint", "points", "mean_latency", "max_latency",
        )
    )


def stream_silence(
    df: DataFrame,
    gap: str = "1 day",
    watermark: str = "1 hour",
    ts: str = "ts",
    shards: int = 32,
) -> DataFrame:
    """(shard, first_ts, last_ts, rows): activity sessions of a stream, per shard.

    One session over all rows would be one key and so one task.  Rows are spread over
    shards, rows of one moment over the shards of the tasks that read them, and
    ``merge_sessions`` joins the few shard sessions into overall ones.
    """
    shard = F.pmod(F.xxhash64(F.col(ts), F.spark_partition_id()), F.lit(shards)).alias("shard")
    return (
        df.select(ts, shard)
        .withWatermark(ts, watermark)
        .groupBy(F.session_window(F.col(ts), gap).alias("s"), "shard")
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows"))
        .select("shard", "first_ts", "last_ts", "rows")
    )


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def merge_sessions(sessions: DataFrame, gap_seconds: int = 86_400, block_seconds: int = 86_400) -> DataFrame:
    """(session, first_ts, last_ts, rows, silence_seconds) out of partial sessions.

    A new session starts where ``gap_seconds`` or more passed without a row;
    ``silence_seconds`` is the time since the session before.  Input is one row per
    partial session or time slot.  They are ordered inside blocks of the calendar, many at a time; only one row
    per block, a day unless told otherwise, is ordered over all, to carry the last time and the number of
    sessions from block to block.
    """
    block = F.floor(F.unix_seconds("first_ts") / block_seconds).alias("block")
    times = [F.col(name).cast("timestamp").alias(name) for name in ("first_ts", "last_ts")]
    known = sessions.select(*times, "rows").withColumn("block", block)
    blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = known.groupBy("block").agg(F.max("last_ts").alias("end"))
    carried = ends.select("block", F.max("end").over(blocks).alias("carried"))
    inside = Window.partitionBy("block").orderBy("first_ts", "last_ts")
    reached = F.greatest(F.max("last_ts").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "carried")
    quiet = _seconds(F.col("first_ts"), F.col("reached"))
    opened = (
        known.join(carried, "block")
        .withColumn("reached", reached)
        .withColumn("quiet", quiet)
        .withColumn("opens", F.when(F.col("quiet").isNull() | (F.col("quiet") >= gap_seconds), 1).otherwise(0))
    )
    # Number 0 inside a block goes on with the last session of the blocks before.
    local = opened.withColumn("local", F.sum("opens").over(inside)).groupBy("block", "local").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("rows").alias("rows"),
        F.max(F.when(F.col("opens") == 1, F.col("quiet"))).alias("silence_seconds"),
    )
    numbers = local.groupBy("block").agg(F.max("local").alias("sessions"))
    before = numbers.select("block", F.coalesce(F.sum("sessions").over(blocks), F.lit(0)).alias("before"))
    return (
        local.join(before, "block")
        .groupBy((F.col("before") + F.col("local")).alias("session"))
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("rows").alias("rows"),
            F.max("silence_seconds").alias("silence_seconds"),
        )
    )


def activity_slots(df: DataFrame, gap_seconds: int = 86_400, ts: str = "ts") -> DataFrame:
    """(slot, first_ts, last_ts, rows) per short slot of time.

    Rows of one slot can never be apart by the gap, so this is all that sessions need; slots of
    several frames are merged by ``merge_slots``.
    """
    slot = max(1, gap_seconds // 24)
    moment = F.col(ts).cast("timestamp")
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.floor(F.unix_seconds(moment) / slot).alias("slot"))
        .agg(F.min(moment).alias("first_ts"), F.max(moment).alias("last_ts"), F.count(F.lit(1)).alias("rows"))
    )


def merge_slots(slots: DataFrame) -> DataFrame:
    """Slots of several batches as one; the order in which they came does not matter."""
    return slots.groupBy("slot").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("rows").alias("rows")
    )


def activity_sessions(df: DataFrame, gap_seconds: int = 86_400, ts: str = "ts") -> DataFrame:
    """Sessions of a batch frame, exactly as ``stream_silence`` finds them.

    Each slot is first reduced to its first and last time; what is left is as long as the calendar.
    """
    return merge_sessions(activity_slots(df, gap_seconds, ts), gap_seconds)


def stream_slots(df: DataFrame, path: str, checkpoint: str, gap_seconds: int = 86_400, ts: str = "ts"):
    """Writer that keeps the slots of a stream under ``path``, one part per batch; start it to run.

    No watermark is needed and no row is too late: ``stored_sessions`` merges what the parts hold.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = part_name(batch.sparkSession, checkpoint, number)
        write_batch(activity_slots(batch, gap_seconds, ts).coalesce(1), path, part)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stored_sessions(spark: SparkSession, path: str, gap_seconds: int = 86_400) -> DataFrame:
    """Sessions of all that ``stream_slots`` has kept with the same gap."""
    reader = spark.read.schema(SLOT_TYPE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return merge_sessions(merge_slots(reader.parquet(path)), gap_seconds)


class LateRows(StreamingQueryListener):
    """Counts what streams drop behind their watermarks, over their whole lives.

    Register one with ``spark.streams.addListener`` before the queries start.  Spark counts after folding
    rows of one batch and window, so those count once.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        dropped = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        key = str(event.progress.id)
        self.counts[key] = self.counts.get(key, 0) + dropped

    def onQueryIdle(self, event) -> None:
        """Nothing arrived."""

    def onQueryTerminated(self, event) -> None:
        """The count stays."""

    def of(self, query) -> int:
        return self.counts.get(str(query.id), 0)
