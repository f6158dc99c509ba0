from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from modlytics.operators.records import log_records
from modlytics.schema import LABELS
from modlytics.sources import comments as cs
from modlytics.sources import logs as lg
from modlytics.sources.runs import read_run_metrics, run_rows, run_table, write_run_metrics


def test_csv_round_trip_keeps_quotes_lines_and_nulls(spark, comments, folder):
    odd = spark.createDataFrame(
        [("7", 'He said "no", twice\nand left', 0), ("8", None, 1)],
        "comment_id string, comment_text string, toxic int",
    )
    df = comments.unionByName(odd, allowMissingColumns=True)
    cs.write_comments(df, f"{folder}/csv")
    back = cs.read_comments(spark, f"{folder}/csv")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.select(back.columns).collect()}
    assert back.columns == ["comment_id", "comment_text", *LABELS]


def test_missing_label_columns_are_named(spark, folder):
    path = f"{folder}/short.csv"
    with open(path, "w") as f:
        f.write("comment_text,toxic\ntest,1\n")
    absent = ["severe_toxic", "obscene", "threat", "insult", "identity_hate"]
    with pytest.raises(ValueError) as problem:
        cs.read_comments(spark, path)
    assert str(problem.value) == f"Missing target columns: {absent}"
    comments = spark.createDataFrame([("1", "test", 1)], "comment_id string, comment_text string, toxic int")
    comments.write.parquet(f"{folder}/p")
    with pytest.raises(ValueError, match="Missing target columns"):
        cs.read_comments(spark, f"{folder}/p", "parquet")


def test_csv_columns_in_any_order_with_or_without_an_id(spark, folder):
    names = ",".join(reversed(LABELS))
    bare, named, wrong = f"{folder}/bare.csv", f"{folder}/named.csv", f"{folder}/wrong.csv"
    with open(bare, "w") as f:
        f.write(f"comment_text,{names}\nThis is a good comment,0,0,0,0,0,0\nI hate you so much,1,0,1,0,1,1\n")
    with open(named, "w") as f:
        f.write(f"id,{names},note,comment_text\nx9,1,0,0,0,0,1,odd,hello\n")
    with open(wrong, "w") as f:
        f.write(f"comment_text,{names}\nhello,1,0,0,0,0,many\n")
    rows = {r.comment_text: r for r in cs.read_comments(spark, bare).collect()}
    assert rows["I hate you so much"].toxic == 1 and rows["I hate you so much"].insult == 0
    assert len({r.comment_id for r in rows.values()}) == 2
    row = cs.read_comments(spark, named).first()
    assert (row.comment_id, row.identity_hate, row.toxic, row.note) == ("x9", 1, 1, "odd")
    with pytest.raises(Exception):
        cs.read_comments(spark, wrong).collect()


LINES = [
    {"timestamp": "2024-03-01 10:00:00,054", "pathname": "m.py", "endpoint": "/predict", "request_text": "a",
     "prediction_latency": 0.01, "is_toxic": True, "predictions": {"toxic": True}},
    {"timestamp": "2024-03-01T11:00:00+00:00", "endpoint": "/predict_proba", "request_text": "b", "is_toxic": False,
     "max_probability": 0.3, "probabilities": {"toxic": 0.3}, "prediction_latency": 0.02},
    {"timestamp": "2024-03-01T12:00:00+00:00", "endpoint": "/feedback", "request_text": "c",
     "predicted_labels": {"toxic": True}, "true_labels": {"toxic": False}, "is_prediction_correct": False,
     "user_comments": None},
    {"timestamp": "2024-03-01T13:00:00+00:00", "endpoint": "/moderate", "decision": "reject", "confidence": 0.95},
    {"timestamp": "2024-03-01T14:00:00+00:00", "endpoint": "/moderation-queue/review", "queue_id": "123",
     "action": "approve", "moderator_notes": "Looks fine."},
]
BROKEN = ['{"timestamp": "2024-03-01T1', "", "17", '{"is_toxic": "perhaps"}']


def write_lines(folder, lines):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/log.json"
    with open(path, "w") as f:
        f.write("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")
    return path


def test_log_lines(spark, folder):
    path = write_lines(folder, LINES + BROKEN)
    good, bad = lg.read_log_lines(spark, path)
    rows = {r.endpoint: r for r in good.collect()}
    assert len(rows) == 5 and rows["/predict"].predictions == {"toxic": True}
    assert rows["/predict"].probabilities is None and rows["/moderate"].confidence == 0.95
    assert sorted(r[0] for r in bad.collect()) == sorted(BROKEN)


def test_strict_mode_fails_on_a_broken_line(spark, folder):
    path = write_lines(folder, LINES + BROKEN[:1])
    for action in ("collect", "count"):
        with pytest.raises(Exception, match="Broken log line"):
            getattr(lg.read_log_lines(spark, path, "strict")[0], action)()
    blank = write_lines(f"{folder}/blank", [*LINES, ""])
    with pytest.raises(Exception, match="Broken log line"):
        lg.read_log_lines(spark, blank, "strict")[0].count()
    whole = write_lines(f"{folder}/whole", LINES)
    assert lg.read_log_lines(spark, whole, "strict")[0].count() == 5
    with pytest.raises(ValueError):
        lg.read_log_lines(spark, path, "lenient")


def test_items_without_data_or_with_broken_json_are_skipped(spark):
    items = spark.createDataFrame(
        [(json.dumps(LINES[0]),), (None,), ("{broken",), (json.dumps(LINES[3]),)], "data string"
    )
    assert sorted(r.endpoint for r in lg.read_log_items(items).collect()) == ["/moderate", "/predict"]
    assert lg.read_log_items(items, max_items=1).count() == 1


def test_stores_are_united_once(spark, folder):
    good, _ = lg.read_log_lines(spark, write_lines(folder, LINES))
    primary = good.filter("endpoint != '/feedback'")
    twice = primary.unionByName(primary)
    rows = {r.endpoint: r.log_source for r in lg.read_logs(twice, good).collect()}
    assert rows == {e["endpoint"]: "primary" if e["endpoint"] != "/feedback" else "fallback" for e in LINES}
    assert lg.read_logs(twice, good).count() == 5


def records(spark):
    df = spark.range(96).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-03-01").cast("timestamp")).alias("at"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"),
    )
    return df, {"endpoint": F.lit("/predict"), "request_text": F.col("t"), "timestamp": F.col("at").cast("string")}


def test_written_items_come_back_and_ranges_prune(spark, folder):
    df, fields = records(spark)
    rows = log_records(df, fields)
    items = lg.log_items(rows, F.to_timestamp("timestamp"), level="WARNING")
    path = f"{folder}/log"
    lg.write_log(items, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("log_date")) == [
        f"log_date=2024-03-0{day}" for day in (1, 2, 3, 4)
    ]
    back = lg.read_log_items(spark.read.parquet(path))
    assert {r.request_text for r in back.collect()} == {f"text {i}" for i in range(96)}
    assert {r.log_level for r in back.collect()} == {"WARNING"}

    part = lg.read_log_range(spark, path, "2024-03-02 12:00:00", "2024-03-03 06:00:00")
    texts = {r.request_text for r in lg.read_log_items(part).collect()}
    assert texts == {f"text {i}" for i in range(36, 54)}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_item_keys(spark):
    df, fields = records(spark)
    item = lg.log_items(log_records(df, fields), F.to_timestamp("timestamp")).first()
    assert item.partition_key.startswith("2024-03-01#") and len(item.partition_key) == 19
    assert item.sort_key.startswith(item.timestamp + "#")
    assert json.loads(item.data)["log_date"] == "2024-03-01"


def test_run_rows_round_trip(spark, folder):
    metrics = spark.createDataFrame([("mean_auc", 0.9), ("exact_match_accuracy", 0.8)], "name string, value double")
    write_run_metrics(run_rows(metrics, "r1", "a", {"algorithm": "A", "position": 0}), f"{folder}/runs")
    write_run_metrics(run_rows(metrics, "r2", "b", {}), f"{folder}/runs")
    runs = {r.run_id: r for r in run_table(read_run_metrics(spark, f"{folder}/runs")).collect()}
    assert runs["r1"].algorithm == "A" and runs["r1"].position == 0 and runs["r1"].mean_auc == 0.9
    assert runs["r2"].algorithm is None and runs["r2"].exact_match_accuracy == 0.8
    # A run that is written again replaces itself; figures of two runs do not mix.
    worse = spark.createDataFrame([("mean_auc", 0.5)], "name string, value double")
    write_run_metrics(run_rows(worse, "r1", "a", {}), f"{folder}/runs")
    runs = {r.run_id: r for r in run_table(read_run_metrics(spark, f"{folder}/runs")).collect()}
    assert (runs["r1"].mean_auc, runs["r1"].exact_match_accuracy, runs["r2"].mean_auc) == (0.5, None, 0.9)


def test_stores_may_order_their_columns_and_maps_differently(spark):
    flags = F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(False))
    turned = F.create_map(F.lit("b"), F.lit(False), F.lit("a"), F.lit(True))
    base = spark.createDataFrame([("t1", "/predict", "x"), ("t2", "/predict", "y")], "timestamp string, endpoint string, _note string")
    primary = base.select("timestamp", "endpoint", "_note", flags.alias("predictions"), F.lit(None).cast("double").alias("score"))
    fallback = base.select(turned.alias("predictions"), "_note", "endpoint", "timestamp")
    both = lg.read_logs(primary, fallback)
    assert "_note" in both.columns
    assert sorted((r.timestamp, r["_note"], r.log_source) for r in both.collect()) == [("t1", "x", "primary"), ("t2", "y", "primary")]
