"""H: streaming.  Stateless queries run as real streams over the given files; windowed
ones run their batch form, which the tests hold equal to the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import check, r6, shown
from checks.sql import ACTIVITY, BASE, PREDICTIONS, SCORED, decided, iso, query
from checks.sql import shown as shown_sql
from checks.f_moderation import REVIEW_CTES
from modlytics.functions.values import iso_utc, round_half_even
from modlytics.operators.monitor import parse_predictions
from modlytics.plans import views
from modlytics.plans.moderation import read_committed
from modlytics.schema import QUEUE_SCHEMA, REVIEW_SCHEMA
from modlytics.session import require_folder
from modlytics.sources.logs import event_time, log_items, write_log
from modlytics.sources.queue_store import purge_stored_queue
from modlytics.streaming import moderation as sm
from modlytics.streaming.logs import dedupe_log, stream_logs
from modlytics.streaming.windows import (
    late_rows,
    stored_sessions,
    stored_toxicity,
    stream_latency,
    stream_slots,
    stream_toxicity,
    stream_toxicity_table,
)


def fresh(spark, name):
    return f"{require_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drain(writer):
    """Run a stream over all that is there, then stop."""
    query_ = writer.trigger(availableNow=True).start()
    query_.awaitTermination()


ARRIVED = query(
    BASE,
    f"""SELECT {iso('ts')} AS "timestamp", {shown_sql('ts')} AS ts, endpoint,
  CASE WHEN endpoint <> '/moderation-queue/review' THEN request_text END AS request_text FROM calls""",
)


def arrive(spark, logs, path):
    """Run a log stream over all that is there; a second call goes on where the first has stopped."""
    rows = logs.select("timestamp", shown(F.col("ts")).alias("ts"), "endpoint", "request_text")
    drain(rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state"))
    return spark.read.parquet(f"{path}/out")


@check("h1_stream_logs", ARRIVED)
def h1(spark, sf):
    """The log is written as the dated item table and read back as a stream."""
    path = fresh(spark, "log")
    records = event_time(views.logs(spark, sf))
    write_log(log_items(records.drop("ts"), F.to_timestamp("timestamp")), f"{path}/items")
    return arrive(spark, stream_logs(spark, f"{path}/items", "parquet"), path)


@check("h1_tail_logs", ARRIVED)
def h1_tail(spark, sf):
    """The log is written as JSON lines in two halves and followed by a stream that stops between them."""
    path = fresh(spark, "log")
    records = views.logs(spark, sf)
    early = F.coalesce(F.pmod(F.xxhash64("timestamp"), F.lit(2)) == 0, F.lit(True))
    for half in (early, ~early):
        records.filter(half).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{path}/log")
        arrived = arrive(spark, stream_logs(spark, f"{path}/log"), path)
    return arrived


def stream_of(spark, sf, name):
    """A given table, one file or a folder of part files, as a file stream."""
    schema = views.table(spark, sf, name).schema
    # A pattern, as only that may be one file as well as a folder of part files.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@check(
    "h2_stream_moderate",
    query(
        [SCORED, decided("(SELECT * FROM scored WHERE length(comment_text) BETWEEN 1 AND 5000) s")],
        """SELECT comment_id, action, confidence, reasoning,
  CASE WHEN action = 'human_review' THEN 'mod_20240131_000000_' || md5(CAST(comment_id AS VARCHAR)) END AS queue_id FROM decided""",
    ),
)
def h2(spark, sf):
    path = fresh(spark, "moderated")
    requests = stream_of(spark, sf, "documents").select(
        F.col("doc_id").alias("comment_id"), F.col("text").alias("comment_text")
    )
    drain(
        sm.stream_moderate(
            requests,
            lambda rows: views.with_scores(rows, "comment_id"),
            path,
            F.lit("2024-01-31 00:00:00").cast("timestamp"),
            f"{path}/state",
        )
    )
    return read_committed(spark, path, "decisions").select(
        "comment_id", "action", "confidence", "reasoning", "queue_id"
    )


@check(
    "h3_stream_toxicity",
    query(
        BASE + [PREDICTIONS],
        f"""SELECT {shown_sql('window_start')} AS window_start, {shown_sql("window_start + INTERVAL 1 DAY")} AS window_end, total, toxic_count,
  round_even(CAST(toxic_count AS DOUBLE) / total, 3) AS toxic_rate
FROM (SELECT w AS window_start, count(*) AS total, count(*) FILTER (is_toxic) AS toxic_count FROM (
  SELECT is_toxic, unnest([date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END,
    date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 0 HOUR ELSE INTERVAL (-12) HOUR END]) AS w
  FROM predictions) x GROUP BY w) y""",
    ),
)
def h3(spark, sf):
    """Sliding windows of a day, every half day."""
    windows = stream_toxicity(
        parse_predictions(views.logs(spark, sf)), window="1 day", slide="12 hours"
    )
    return windows.withColumns({n: shown(F.col(n)) for n in ("window_start", "window_end")})


@check(
    "h3_late_rows",
    query(
        BASE + [PREDICTIONS],
        f"""SELECT {shown_sql('w')} AS window_start, count(*) FILTER (NOT late) AS total,
  count(*) FILTER (is_toxic AND NOT late) AS toxic_count, count(*) FILTER (late) AS late
FROM (SELECT p.*, date_trunc('hour', ts) AS w, ts < TIMESTAMP '2024-01-15' AND
    date_trunc('hour', ts) + INTERVAL 1 HOUR <= m.top - INTERVAL 12 HOUR AS late
  FROM predictions p CROSS JOIN (SELECT max(ts) AS top FROM predictions WHERE ts >= TIMESTAMP '2024-01-15'
    AND ts < TIMESTAMP '2024-01-15 06:00:00') m WHERE ts < TIMESTAMP '2024-01-15 06:00:00') x GROUP BY w""",
    ),
)
def h3_late(spark, sf):
    """Six hours of predictions come first, then all before them: most of these are late by more than half a day."""
    path = fresh(spark, "late")
    columns = ["ts", "is_toxic"]
    rows = parse_predictions(views.logs(spark, sf)).select(*columns).filter("ts < '2024-01-15 06:00:00'")
    for part in ("ts >= '2024-01-15'", "ts < '2024-01-15'"):
        rows.filter(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("ts timestamp, is_toxic boolean").parquet(f"{path}/in")
        drain(stream_toxicity_table(stream, path, f"{path}/state", window="1 hour", watermark="12 hours"))
    late = late_rows(spark, path).groupBy("window_start").agg(F.count(F.lit(1)).alias("late"))
    both = stored_toxicity(spark, path).select("window_start", "total", "toxic_count").join(late, "window_start", "full")
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("total", "toxic_count", "late")]
    return both.select(shown(F.col("window_start")).alias("window_start"), *counts)


@check(
    "h4_stream_latency",
    query(
        BASE + [PREDICTIONS],
        f"""SELECT {shown_sql('w')} AS window_start, {shown_sql("w + INTERVAL 1 HOUR")} AS window_end, endpoint, points,
  round_even(mean, 11) AS mean_latency, top AS max_latency
FROM (SELECT date_trunc('hour', ts) AS w, endpoint, count(*) AS points, avg(prediction_latency) AS mean, max(prediction_latency) AS top
  FROM predictions GROUP BY ALL) x""",
    ),
)
def h4(spark, sf):
    # Means of few values with five decimals often lie halfway at the sixth place, so they
    # are compared at eleven.
    windows = stream_latency(parse_predictions(views.logs(spark, sf)))
    return windows.withColumns(
        {"window_start": shown(F.col("window_start")), "window_end": shown(F.col("window_end")),
         "mean_latency": round_half_even(F.col("mean_latency"), 11)}
    )


@check(
    "h5_stream_silence",
    query(
        [ACTIVITY],
        f"""SELECT {shown_sql('min(ts)')} AS first_ts, {shown_sql('max(ts)')} AS last_ts, count(*) AS rows,
  round_even(max(CASE WHEN opens = 1 THEN quiet END), 6) AS silence_seconds
FROM (SELECT *, sum(opens) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN quiet IS NULL OR quiet >= 300 THEN 1 ELSE 0 END AS opens FROM (
    SELECT ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / CAST(1000000 AS DOUBLE) AS quiet FROM activity) a) b) c
GROUP BY session""",
    ),
)
def h5(spark, sf):
    """Five minutes instead of a day, as the given events never pause for a day.

    The calls arrive as a stream, a file at a time, which keeps its slots; sessions are read off them.
    """
    path = fresh(spark, "activity")
    views.activity(spark, sf).select("ts").repartition(4).write.parquet(f"{path}/in")
    calls = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    drain(stream_slots(calls, f"{path}/slots", f"{path}/state", gap_seconds=300))
    sessions = stored_sessions(spark, f"{path}/slots", gap_seconds=300)
    return sessions.select(
        shown(F.col("first_ts")).alias("first_ts"), shown(F.col("last_ts")).alias("last_ts"), "rows",
        r6("silence_seconds").alias("silence_seconds"),
    )


@check(
    "h6_stream_queue",
    query(
        REVIEW_CTES,
        f"""SELECT queue_id, status, final_action, {shown_sql('reviewed_at')} AS reviewed_at FROM reviewed
WHERE created_at >= TIMESTAMP '2024-01-20'""",
    ),
)
def h6(spark, sf):
    """Items and reviews arrive as two file streams; old items are purged from the stored queue, which is read then."""
    path = fresh(spark, "queue")
    views.review_queue(spark, sf).write.parquet(f"{path}/in/items")
    views.reviews(spark, sf).write.parquet(f"{path}/in/reviews")
    items = spark.readStream.schema(QUEUE_SCHEMA).parquet(f"{path}/in/items")
    reviews = spark.readStream.schema(REVIEW_SCHEMA).parquet(f"{path}/in/reviews")
    drain(sm.stream_queue(items, reviews, path, f"{path}/state"))
    as_of = F.lit("2024-02-19 00:00:00").cast("timestamp")
    purge_stored_queue(spark, path, as_of)
    state, _ = sm.queue_state(spark, path)
    return state.select("queue_id", "status", "final_action", shown(F.col("reviewed_at")).alias("reviewed_at"))


@check(
    "h7_dedupe_log",
    query(
        [ACTIVITY],
        f"""SELECT DISTINCT {iso('ts')} AS "timestamp", endpoint, request_text, prediction_latency FROM activity""",
    ),
)
def h7(spark, sf):
    """The log of both stores together, where /predict records are in both, as one stream."""
    records = views.activity(spark, sf).select(
        iso_utc(F.col("ts")).alias("timestamp"), "ts", "endpoint", "request_text", "prediction_latency"
    )
    both = records.unionByName(records.filter(F.col("endpoint") == "/predict"))
    path = fresh(spark, "copies")
    both.write.parquet(f"{path}/in")
    once = dedupe_log(spark.readStream.schema(both.schema).parquet(f"{path}/in")).drop("ts")
    drain(once.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state"))
    return spark.read.parquet(f"{path}/out")
