"""Every stream gives what its batch operator gives."""

from __future__ import annotations

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from modlytics.operators.moderation import decide
from modlytics.plans import moderation as plan
from modlytics.schema import QUEUE_SCHEMA, REVIEW_SCHEMA
from modlytics.sources import queue_store as store
from modlytics.streaming import moderation as sm
from modlytics.streaming import windows as stored
from modlytics.streaming.logs import dedupe_log, stream_log_tables, stream_logs, stream_parsed
from modlytics.streaming.parts import part_name
from modlytics.streaming.windows import (
    LateRows,
    activity_sessions,
    merge_sessions,
    stream_latency,
    stream_silence,
    stream_toxicity,
)
from tests.conftest import at

START = datetime.datetime(2024, 3, 1)


def stamp(minutes):
    return (START + datetime.timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def put(folder, name, records):
    """One file per call; file times order the stream's batches."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.json"
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    order = len(os.listdir(folder))
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


def record(minutes, toxic=False, latency=0.5, endpoint="/predict", text="t"):
    return {"timestamp": stamp(minutes) + ",000", "endpoint": endpoint, "request_text": text, "is_toxic": toxic,
            "prediction_latency": latency, "predictions": {"toxic": toxic}}


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_logs_arrive_in_parts_and_broken_lines_are_passed_over(spark, folder):
    put(f"{folder}/in", "a", [record(0), "{broken"])
    def run():
        logs = stream_logs(spark, f"{folder}/in").select("timestamp", "ts", "endpoint")
        drain(logs.writeStream.format("parquet").option("path", f"{folder}/out")
              .option("checkpointLocation", f"{folder}/state"))
        return spark.read.parquet(f"{folder}/out").count()

    assert run() == 1
    put(f"{folder}/in", "b", [record(1), record(2)])
    assert run() == 3
    assert run() == 3


def windows(spark, folder, build, keep_state=True):
    """Run a windowed stream in append mode, one file per batch."""
    logs = stream_logs(spark, f"{folder}/in", files_per_batch=1)
    writer = (build(logs).writeStream.format("parquet").outputMode("append")
              .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    query = drain(writer)
    return spark.read.parquet(f"{folder}/out"), query


def test_windows_equal_the_batch_form_and_late_rows_are_counted(spark, folder):
    first = [record(m, toxic=m % 3 == 0, latency=m / 100) for m in range(0, 120, 10)]
    second = [record(m, toxic=True, latency=0.1) for m in range(300, 360, 20)]
    late = [record(5), record(7), record(65)]
    closing = [record(1000)]
    # A batch drops rows by the watermark the batch before the last one left.
    for name, part in (("a", first), ("b", second[:1]), ("c", second[1:]), ("d", late), ("e", closing)):
        put(f"{folder}/in", name, part)
    build = lambda df: stream_toxicity(df, window="1 hour", watermark="30 minutes")
    listener = LateRows()
    spark.streams.addListener(listener)
    out, query = windows(spark, folder, build)
    on_time = spark.createDataFrame(
        [(r["timestamp"][:-4], r["is_toxic"]) for r in first + second], "t string, is_toxic boolean"
    ).select(F.col("t").cast("timestamp").alias("ts"), "is_toxic")
    assert rows(out) == rows(build(on_time))
    # The two rows of the first hour were folded before they were dropped.
    for _ in range(50):
        if listener.of(query) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert listener.of(query) == 2


def test_late_rows_are_kept_whole_and_change_no_window(spark, folder, monkeypatch):
    def arrive(name, records):
        put(f"{folder}/in", name, records)
        run()

    def run():
        logs = stream_logs(spark, f"{folder}/in", files_per_batch=1)
        drain(stored.stream_toxicity_table(logs, folder, f"{folder}/state", window="1 hour", watermark="30 minutes"))

    first, second = [record(m, toxic=m % 3 == 0) for m in range(0, 120, 10)], [record(m, toxic=True) for m in range(100, 360, 20)]
    arrive("a", first)
    arrive("b", second)
    shown = rows(stored.stored_toxicity(spark, folder))
    late = [record(5), record(7), record(65, toxic=True)]
    arrive("c", [*late, record(301)])
    on_time = spark.createDataFrame(
        [(r["timestamp"][:-4], r["is_toxic"]) for r in [*first, *second, record(301)]], "t string, is_toxic boolean"
    ).select(F.col("t").cast("timestamp").alias("ts"), "is_toxic")
    assert rows(stored.stored_toxicity(spark, folder)) == rows(stream_toxicity(on_time, window="1 hour"))
    kept = stored.late_rows(spark, folder)
    assert sorted(str(r.ts)[11:16] for r in kept.collect()) == ["00:05", "00:07", "01:05"]
    assert rows(kept.groupBy("window_start").count()) == [("2024-03-01 00:00:00", "2"), ("2024-03-01 01:00:00", "1")]
    # A batch that ends before its mark does not show; it does when it runs again, once.
    before = rows(stored.stored_toxicity(spark, folder))
    put(f"{folder}/in", "d", [record(1), record(302)])
    with monkeypatch.context() as patch:
        patch.setattr(stored, "put_once", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    assert rows(stored.stored_toxicity(spark, folder)) == before != shown
    run()
    run()
    assert stored.late_rows(spark, folder).count() == 4
    assert stored.stored_toxicity(spark, folder).agg(F.sum("total")).first()[0] == len(first) + len(second) + 2


def test_a_hot_record_is_spread_before_it_is_dropped(spark, folder):
    for name in "abcdefgh":
        put(f"{folder}/in", name, [record(0, text="hot")] * 50 + [record(ord(name))])
    query = drain(dedupe_log(stream_logs(spark, f"{folder}/in", files_per_batch=8), shards=4).writeStream.format("parquet")
                  .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    assert spark.read.parquet(f"{folder}/out").count() == 9
    # The last step meets one copy per shard and no more.
    steps = [p["stateOperators"] for p in query.recentProgress if p["numInputRows"]][0]
    rest = min(op["customMetrics"]["numDroppedDuplicateRows"] for op in steps)
    assert len(steps) == 2 and rest <= 3


def test_a_stream_follows_new_model_versions(spark, folder):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from modlytics.sources.models import ModelFollower, load_version, newest_model_version, publish_model

    model = lambda n: PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {n} AS answer FROM __THIS__")])
    facts = spark.range(1).select(F.lit("rule").alias("algorithm"))
    path, follow = f"{folder}/models", ModelFollower(spark, f"{folder}/models", lambda df, m: m.transform(df))
    with pytest.raises(FileNotFoundError):
        follow(spark.range(1))
    assert publish_model(model(1), facts, path) == 1
    old = follow(spark.range(1))
    seen = []
    os.makedirs(f"{folder}/in")
    rates = spark.readStream.schema("id bigint").parquet(f"{folder}/in")
    def run(n):
        spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        writer = rates.writeStream.foreachBatch(lambda df, _: seen.extend((r.id, r.answer) for r in follow(df).collect()))
        drain(writer.option("checkpointLocation", f"{folder}/state"))
    run(1)
    assert publish_model(model(2), facts, path) == 2
    run(2)
    assert seen == [(1, 1), (2, 2)] and old.first().answer == 1
    assert newest_model_version(spark, path) == 2 and load_version(spark, path, 1)[0].transform(spark.range(1)).first().answer == 1


def test_broken_lines_of_a_stream_are_kept(spark, folder):
    put(f"{folder}/in", "a", [record(1), record(2)])
    with open(f"{folder}/in/b.json", "w") as file:
        file.write('{"timestamp": "cut\n')
    drain(stream_log_tables(stream_parsed(spark, f"{folder}/in"), folder, f"{folder}/state"))
    assert sm.read_batches(spark, f"{folder}/records").count() == 2
    assert [r[0] for r in sm.read_batches(spark, f"{folder}/broken").collect()] == ['{"timestamp": "cut']


def test_sliding_windows_and_latency(spark, folder):
    put(f"{folder}/in", "a", [record(m, latency=m / 10) for m in (0, 20, 40, 70)] + [record(10, latency=None)])
    put(f"{folder}/in", "b", [record(1000)])
    build = lambda df: stream_latency(df, window="1 hour", watermark="10 minutes")
    out, _ = windows(spark, folder, build)
    got = sorted((str(r.window_start), r.endpoint, r.points, round(r.mean_latency, 6), r.max_latency) for r in out.collect())
    assert got == [("2024-03-01 00:00:00", "/predict", 3, 2.0, 4.0), ("2024-03-01 01:00:00", "/predict", 1, 7.0, 7.0)]
    df = spark.createDataFrame([(stamp(10), True)], "t string, is_toxic boolean").select(
        F.col("t").cast("timestamp").alias("ts"), "is_toxic")
    assert stream_toxicity(df, window="1 hour", slide="30 minutes").count() == 2


def test_silence(spark, folder):
    minutes = [0, 20, 50, 300, 310, 2000]
    put(f"{folder}/in", "a", [record(m) for m in minutes])
    put(f"{folder}/in", "b", [record(9000)])
    build = lambda df: stream_silence(df, gap="1 hour", watermark="10 minutes", shards=4)
    out, _ = windows(spark, folder, build)
    closed = out.filter(F.col("first_ts") < F.lit("2024-03-06").cast("timestamp"))
    streamed = merge_sessions(closed, 3600).orderBy("first_ts")
    batch = spark.createDataFrame([(stamp(m),) for m in minutes], "t string").select(
        F.col("t").cast("timestamp").alias("ts"))
    direct = activity_sessions(batch, 3600).orderBy("first_ts")
    assert rows(streamed) == rows(direct)
    got = [(r.rows, r.silence_seconds) for r in direct.collect()]
    assert got == [(3, None), (2, 250 * 60), (1, 1690 * 60)]


def test_sessions_across_days_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    gap = 3 * 86_400
    for span in (20, 200):
        seconds = sorted(rng.randrange(span * 86_400) for _ in range(60))
        df = spark.createDataFrame([(START + datetime.timedelta(seconds=s),) for s in seconds], "ts timestamp")
        want, quiet = [], None
        for i, s in enumerate(seconds):
            if i == 0 or s - seconds[i - 1] >= gap:
                quiet = float(s - seconds[i - 1]) if i else None
                want.append([s, s, 0, quiet])
            want[-1][1:3] = [s, want[-1][2] + 1]
        got = activity_sessions(df, gap).orderBy("first_ts").collect()
        first = lambda r: (r.first_ts - START).total_seconds()
        assert [[first(r), (r.last_ts - START).total_seconds(), r.rows, r.silence_seconds] for r in got] == want
        assert [r.session for r in got] == list(range(1, len(want) + 1))
        # Partial sessions may overlap and span days, in any order and block.
        parts = [stored.merge_sessions(stored.activity_slots(df.sample(0.5, seed), gap), gap) for seed in (1, 2)]
        whole = df.sample(0.5, 1).unionByName(df.sample(0.5, 2))
        merged = merge_sessions(parts[0].unionByName(parts[1]), gap, block_seconds=86_400)
        assert rows(merged.drop("session")) == rows(activity_sessions(whole, gap).drop("session"))


def test_stored_slots_equal_the_batch_form(spark, folder):
    minutes = [[0, 20, 50], [300, 2000], [10, 310]]
    for i, part in enumerate(minutes):
        put(f"{folder}/in", "abc"[i], [record(m) for m in part])
    logs = stream_logs(spark, f"{folder}/in", files_per_batch=1)
    for _ in range(2):
        drain(stored.stream_slots(logs, f"{folder}/slots", f"{folder}/state", 3600))
    got = stored.stored_sessions(spark, f"{folder}/slots", 3600)
    batch = spark.createDataFrame([(stamp(m),) for part in minutes for m in part], "t string").select(
        F.col("t").cast("timestamp").alias("ts"))
    assert rows(got) == rows(activity_sessions(batch, 3600)) and got.count() == 3


def test_a_gap_of_exactly_the_limit_opens_a_session(spark):
    df = spark.createDataFrame([(stamp(m),) for m in (0, 59, 119, 178)], "t string").select(
        F.col("t").cast("timestamp").alias("ts"))
    assert activity_sessions(df, 3600).count() == 2
    assert activity_sessions(df.limit(0), 3600).count() == 0


def test_copies_are_dropped_on_a_stream_and_in_a_batch(spark, folder):
    put(f"{folder}/in", "a", [record(0, text="x"), record(0, text="x"), record(0, text="y")])
    put(f"{folder}/in", "b", [record(0, text="x"), record(1, text="x")])
    logs = stream_logs(spark, f"{folder}/in", files_per_batch=1)
    drain(dedupe_log(logs).select("timestamp", "request_text").writeStream.format("parquet")
          .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    out = spark.read.parquet(f"{folder}/out")
    assert out.count() == 3
    static = spark.read.text(f"{folder}/in")
    from modlytics.sources.logs import event_time, parse_log_lines

    batch = dedupe_log(event_time(parse_log_lines(static).drop("_corrupt_record")))
    assert rows(batch.select("timestamp", "request_text")) == rows(out)


def scorer(df):
    """A stand-in model: an insult is an insult."""
    hit = F.col("comment_text").contains("insult")
    for label in ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"):
        top = F.when(hit, 0.8).otherwise(0.1) if label == "toxic" else F.lit(0.05)
        df = df.withColumn(f"{label}_prob", top).withColumn(f"{label}_pred", F.col(f"{label}_prob") > 0.5)
    return df


def test_moderation_stream(spark, folder):
    schema = "comment_id string, comment_text string"
    first = spark.createDataFrame([("1", "an insult"), ("2", "hello"), ("3", "")], schema)
    first.coalesce(1).write.parquet(f"{folder}/in")

    def run():
        requests = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        drain(sm.stream_moderate(requests, scorer, folder, at(spark, "2024-03-01 10:00:00"), f"{folder}/state"))

    run()
    spark.createDataFrame([("4", "another insult")], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    run()
    decisions = sm.read_batches(spark, f"{folder}/decisions")
    want = decide(scorer(spark.read.parquet(f"{folder}/in").filter("comment_text <> ''")))
    columns = ["comment_id", "action", "confidence", "reasoning"]
    assert rows(decisions.select(columns)) == rows(want.select(columns))
    queue = sm.read_batches(spark, f"{folder}/queue")
    assert {r.text for r in queue.collect()} == {"an insult", "another insult"}
    assert sm.read_batches(spark, f"{folder}/log").count() == 3
    assert [r.reasons for r in sm.read_batches(spark, f"{folder}/rejected").collect()] == [["text_too_short"]]
    # A batch that runs again, at another time, meets its own rows and ids.
    ids = {r.queue_id for r in queue.collect()}
    again = spark.createDataFrame([("4", "another insult")], schema)
    part = part_name(spark, f"{folder}/state", 1)
    sm.moderate_table(again, scorer, folder, at(spark, "2024-03-02 11:00:00"), part)
    assert rows(sm.read_batches(spark, f"{folder}/decisions").select(columns)) == rows(want.select(columns))
    assert {r.queue_id for r in sm.read_batches(spark, f"{folder}/queue").collect()} == ids
    # A query from a new checkpoint adds to what is there.
    requests = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
    drain(sm.stream_moderate(requests, scorer, folder, at(spark, "2024-03-03 10:00:00"), f"{folder}/state2"))
    assert sm.read_batches(spark, f"{folder}/decisions").count() == 6


def test_parts_of_a_table_keep_each_other(spark, folder):
    schema = "comment_id string, comment_text string"
    when = at(spark, "2024-03-01 10:00:00")
    monday = spark.createDataFrame([("1", "an insult"), ("2", "hello")], schema)
    tuesday = spark.createDataFrame([("3", "hello again")], schema)
    sm.moderate_table(monday, scorer, folder, when, "day=2024-03-04")
    sm.moderate_table(tuesday, scorer, folder, when, "day=2024-03-05")
    with pytest.raises(ValueError, match="other requests"):
        sm.moderate_table(tuesday, scorer, folder, when, "day=2024-03-04")
    assert {r.comment_id for r in sm.read_batches(spark, f"{folder}/decisions").collect()} == {"1", "2", "3"}
    assert sm.read_batches(spark, f"{folder}/log").count() == 3


@pytest.fixture
def queue_rows(spark):
    def make(pairs):
        df = spark.createDataFrame(pairs, "queue_id string, c string")
        named = {"queue_id": F.col("queue_id"), "created_at": F.col("c").cast("timestamp"),
                 "priority": F.lit("low"), "status": F.lit("pending")}
        return df.select(*(named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in QUEUE_SCHEMA))
    return make


def review_rows(spark, rows_):
    df = spark.createDataFrame(rows_, "queue_id string, action string, r string")
    return df.select("queue_id", "action", F.lit("n").alias("moderator_notes"), F.col("r").cast("timestamp").alias("reviewed_at"))


def test_queue_stream(spark, folder, queue_rows):
    def arrive(items, reviews):
        if items:
            queue_rows(items).coalesce(1).write.mode("append").parquet(f"{folder}/in/items")
        if reviews:
            review_rows(spark, reviews).coalesce(1).write.mode("append").parquet(f"{folder}/in/reviews")
        drain(sm.stream_queue(
            spark.readStream.schema(QUEUE_SCHEMA).parquet(f"{folder}/in/items"),
            spark.readStream.schema(REVIEW_SCHEMA).parquet(f"{folder}/in/reviews"),
            f"{folder}/q", f"{folder}/state",
        ))
        state, unknown = sm.queue_state(spark, f"{folder}/q", at(spark, "2024-03-31"))
        return {r.queue_id: (r.status, r.final_action) for r in state.collect()}, [r.queue_id for r in unknown.collect()]

    state, unknown = arrive([("a", "2024-03-20"), ("b", "2024-03-21"), ("old", "2024-02-01")],
                            [("b", "approve", "2024-03-22"), ("ghost", "approve", "2024-03-22")])
    assert state == {"a": ("pending", None), "b": ("reviewed", "approve")} and unknown == ["ghost"]
    state, _ = arrive([("c", "2024-03-25")], [("b", "reject", "2024-03-23"), ("a", "warn", "2024-03-24")])
    assert state == {"a": ("reviewed", "warn"), "b": ("reviewed", "reject"), "c": ("pending", None)}
    # An item that arrives once more is still one item.
    arrive([("c", "2024-03-25")], [])
    whole, _ = sm.queue_state(spark, f"{folder}/q", at(spark, "2024-03-31"))
    assert whole.count() == 3


def test_stored_queue_reads_the_newest_version_and_later_parts(spark, folder, queue_rows):
    path = f"{folder}/q"
    add = lambda writer, batch, items=(), reviews=(): store.append_entries(
        store.queue_entries(queue_rows(list(items)) if items else None, review_rows(spark, list(reviews)) if reviews else None),
        path, writer, batch)
    state = lambda: {r.queue_id: (r.status, r.final_action) for r in sm.queue_state(spark, path)[0].collect()}
    unknown = lambda: [r.queue_id for r in sm.queue_state(spark, path)[1].collect()]
    assert state() == {} and unknown() == []
    assert add("w", 0, [("a", "2024-03-20"), ("old", "2024-01-01"), ("none", None)])
    assert add("v", 0, reviews=[("b", "warn", "2024-03-21"), ("old ghost", "warn", "2024-01-01"), ("a", "approve", "2024-03-21")])
    before = state()
    assert before == {"a": ("reviewed", "approve"), "old": ("pending", None), "none": ("pending", None)}
    assert store.compact_queue(spark, path) == 0
    assert state() == before and sorted(unknown()) == ["b", "old ghost"]
    # Parts and a snapshot give what parts alone give: an older review changes nothing, a review may come before its item.
    assert add("w", 1, [("b", "2024-03-22"), ("a", "2024-03-25")], [("a", "reject", "2024-03-20")])
    entries = store.read_entries(spark, path)
    assert {r.queue_id: r.item.created_at.day for r in entries.filter("queue_id = 'a'").collect()} == {"a": 20}
    assert state() == before | {"b": ("reviewed", "warn")}
    opened = {name.split("/q/")[1].rsplit("/", 1)[0] for name in entries.inputFiles()}
    assert opened == {f"snapshots/{store.newest_version(spark, path).snapshot}", "entries/query=w/batch=1"}
    # A replay changes nothing, before its part is folded or after.
    assert not add("w", 1, [("x", "2024-03-22")]) and not add("w", 0, [("x", "2024-03-22")])
    # A part without its end is not there.
    os.makedirs(f"{path}/entries/query=w/batch=2")
    assert store.purge_stored_queue(spark, path, at(spark, "2024-03-31")) == 2
    assert state() == {"a": ("reviewed", "approve"), "b": ("reviewed", "warn")} and unknown() == []
    assert len(os.listdir(f"{path}/snapshots")) == 1 and store.finished_parts(spark, path) == []
    assert not add("w", 1, [("x", "2024-03-22")]) and add("w", 2, [("x", "2024-03-22")])
    assert len(state()) == 3


def test_of_two_compactions_one_changes_nothing(spark, folder, queue_rows, monkeypatch):
    path = f"{folder}/q"
    store.append_entries(store.queue_entries(queue_rows([("a", "2024-03-20")])), path, "w", 0)
    stale = store.newest_version(spark, path)
    store.compact_queue(spark, path)
    made = os.listdir(f"{path}/snapshots")
    with monkeypatch.context() as patch:
        patch.setattr(store, "newest_version", lambda *_: stale)
        with pytest.raises(RuntimeError, match="another compaction"):
            store.compact_queue(spark, path)
    assert os.listdir(f"{path}/snapshots") == made and sm.queue_state(spark, path)[0].count() == 1


@pytest.mark.parametrize("step", ["enqueue", "decision_log", "put_once"])
def test_a_part_shows_when_all_its_tables_are_there(spark, folder, monkeypatch, step):
    requests = spark.createDataFrame([("1", "an insult"), ("2", "hello"), ("3", "")], "comment_id string, comment_text string")
    run = lambda: sm.moderate_table(requests, scorer, folder, at(spark, "2024-03-01 10:00:00"), "query=q/batch=0")
    count = lambda: [plan.read_committed(spark, folder, name, QUEUE_SCHEMA).count() for name in plan.TABLES]

    def killed(*_):
        raise InterruptedError

    with monkeypatch.context() as patch:
        patch.setattr(plan, step, killed)
        with pytest.raises(InterruptedError):
            run()
    assert count() == [0, 0, 0, 0]
    for _ in range(2):
        run()
        assert count() == [2, 1, 2, 1]
