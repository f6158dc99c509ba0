"""A: scans, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.registry import check, r6, shown
from checks.sql import ACTIVITY, COMMENTS, METRIC_CTES, SPLIT, iso, query
from checks.sql import shown as shown_sql
from modlytics.functions.values import iso_utc
from modlytics.operators.evaluation import evaluate, metric_names
from modlytics.operators.profile import require_columns
from modlytics.operators.training import as_pipeline, fit_logistic, prepare_vectors, score
from modlytics.plans import views
from modlytics.schema import LABELS
from modlytics.session import require_folder
from modlytics.sources.comments import join_labels, read_comments, write_comments
from modlytics.sources.logs import (
    CORRUPT,
    log_items,
    read_log_items,
    read_log_lines,
    read_log_range,
    read_logs,
    write_log,
)
from modlytics.sources.models import ModelFollower, load_model, publish_model, save_model
from modlytics.sources.runs import read_run_metrics, run_rows, write_run_metrics

LABEL_LIST = ", ".join(LABELS)


def _fresh(spark, name):
    return f"{require_folder(spark)}/{name}-{uuid.uuid4().hex}"


@check(
    "a1_read_comments",
    query([COMMENTS], f"SELECT comment_id, comment_text, lang, source, {LABEL_LIST} FROM comments"),
)
def a1(spark, sf):
    """The comments are written as CSV and read back; language and source come from their documents."""
    path = _fresh(spark, "comments")
    write_comments(views.comments(spark, sf), path)
    read = read_comments(spark, path)
    documents = views.table(spark, sf, "documents")
    origin = documents.select(F.col("doc_id").cast("string").alias("comment_id"), "lang", "source")
    texts = read.select("comment_id", "comment_text").join(origin, "comment_id")
    joined = join_labels(texts, read.select("comment_id", *LABELS))
    return joined.withColumn("comment_id", F.col("comment_id").cast("bigint"))


@check(
    "a2_require_columns",
    query([COMMENTS], f"SELECT comment_id, {LABEL_LIST} FROM comments"),
)
def a2(spark, sf):
    return require_columns(views.comments(spark, sf)).select("comment_id", *LABELS)


@check(
    "a3_read_log_lines",
    query(
        [ACTIVITY],
        f"""SELECT event_id, value >= 50 AS broken,
  CASE WHEN value < 50 THEN endpoint END AS endpoint,
  CASE WHEN value < 50 THEN {iso('ts')} END AS "timestamp",
  CASE WHEN value < 50 THEN request_text END AS request_text FROM activity""",
    ),
)
def a3(spark, sf):
    calls = views.activity(spark, sf)
    number = F.col("event_id").cast("string").alias("message")
    record = F.to_json(
        F.struct(
            number, iso_utc(F.col("ts")).alias("timestamp"), "endpoint", "request_text", "prediction_latency"
        )
    )
    # Slow calls stand for lines cut off while being written.
    line = F.when(F.col("value") >= 50, F.substring(record, 1, 40)).otherwise(record)
    path = _fresh(spark, "lines")
    calls.select(line.alias("value")).write.text(path)
    good, bad = read_log_lines(spark, path)
    cut = bad.select(F.regexp_extract(CORRUPT, '"message":"([0-9]+)"', 1).alias("message"))
    both = good.withColumn("broken", F.lit(False)).unionByName(cut.withColumn("broken", F.lit(True)), allowMissingColumns=True)
    return both.select(
        F.col("message").cast("bigint").alias("event_id"), "broken", "endpoint", "timestamp", "request_text"
    )


@check(
    "a4_read_log_items",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
)
def a4(spark, sf):
    items = views.table(spark, sf, "events").select("event_id", F.col("props").alias("data"))
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return read_log_items(items, schema=schema, keep=("event_id",))


@check(
    "a5_read_logs",
    query(
        [ACTIVITY],
        f"""SELECT {iso('ts')} AS "timestamp", endpoint, request_text, prediction_latency,
  CASE WHEN bool_or(store = 0) THEN 'primary' ELSE 'fallback' END AS log_source
FROM (SELECT *, 0 AS store FROM activity WHERE endpoint <> '/feedback'
  UNION ALL SELECT *, 1 FROM activity WHERE endpoint IN ('/feedback', '/predict')) b
GROUP BY ts, endpoint, request_text, prediction_latency""",
    ),
)
def a5(spark, sf):
    records = views.activity(spark, sf).select(
        iso_utc(F.col("ts")).alias("timestamp"), "endpoint", "request_text", "prediction_latency"
    )
    primary = records.filter(F.col("endpoint") != "/feedback")
    fallback = records.filter(F.col("endpoint").isin("/feedback", "/predict"))
    return read_logs(primary, fallback)


ITEM_ORACLE = f"""SELECT event_id, {iso('ts')} AS "timestamp", strftime(ts, '%Y-%m-%d') AS log_date, 'INFO' AS log_level,
  strftime(ts, '%Y-%m-%d') || '#' AS day_key, endpoint, request_text, prediction_latency FROM activity"""


def _items(spark, sf):
    calls = views.activity(spark, sf).select(
        "event_id", "ts", "endpoint", "request_text", "prediction_latency"
    )
    return log_items(calls, F.col("ts"))


def _written_items(spark, sf):
    """The folder of a dated item table that holds all calls."""
    path = _fresh(spark, "items")
    write_log(_items(spark, sf), path)
    return path


def _unwrapped(items):
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("endpoint", T.StringType()),
            T.StructField("request_text", T.StringType()),
            T.StructField("prediction_latency", T.DoubleType()),
        ]
    )
    keep = ("timestamp", "log_date", "log_level", "partition_key")
    return read_log_items(items, schema=schema, keep=keep)


@check("a6_write_log", query([ACTIVITY], ITEM_ORACLE))
def a6(spark, sf):
    items = spark.read.parquet(_written_items(spark, sf)).withColumn("log_date", F.col("log_date").cast("string"))
    return _unwrapped(items).select(
        "event_id", "timestamp", "log_date", "log_level",
        F.substring("partition_key", 1, 11).alias("day_key"),
        "endpoint", "request_text", "prediction_latency",
    )


@check(
    "a7_read_log_range",
    query(
        [ACTIVITY],
        f"""SELECT event_id, {shown_sql('ts')} AS ts, endpoint FROM activity
WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""",
    ),
)
def a7(spark, sf):
    chosen = read_log_range(spark, _written_items(spark, sf), "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("endpoint", T.StringType())]
    )
    rows = read_log_items(chosen, schema=schema, keep=("ts",))
    return rows.select("event_id", shown(F.col("ts")).alias("ts"), "endpoint")


@check(
    "a8_write_run_metrics",
    query(
        METRIC_CTES,
        """SELECT 'run_1' AS run_id, 'logistic_regression' AS model_name, 'metric' AS kind,
  CASE WHEN label = 'all' THEN metric ELSE label || '_' || CASE metric WHEN 'roc_auc' THEN 'auc' ELSE metric END END AS name,
  round_even(value, 6) AS value, NULL AS text FROM metrics
UNION ALL SELECT 'run_1', 'logistic_regression', 'param', 'tfidf_max_features', NULL, '10000'
UNION ALL SELECT 'run_1', 'logistic_regression', 'param', 'tfidf_ngram_range', NULL, '(1, 2)'
UNION ALL SELECT 'run_1', 'logistic_regression', 'param', 'train_size', NULL,
  CAST((SELECT count(*) FROM comments) AS VARCHAR)""",
    ),
)
def a8(spark, sf):
    rows = views.truth_and_scores(spark, sf)
    params = {
        "tfidf_max_features": 10000,
        "tfidf_ngram_range": "(1, 2)",
        "train_size": views.comments(spark, sf).agg(F.count(F.lit(1))).scalar(),
    }
    named = metric_names(evaluate(rows, rows))
    path = _fresh(spark, "runs")
    write_run_metrics(run_rows(named, "run_1", "logistic_regression", params), path)
    return read_run_metrics(spark, path).withColumn("value", r6("value"))


@check("a9_save_load_model")
def a9(spark, sf):
    """Scores of a model that was written and read back, on the held-out comments."""
    prepared = prepare_vectors(views.comments(spark, sf))
    model = as_pipeline(prepared.stages, fit_logistic(prepared.train))
    path = f"{require_folder(spark)}/model-{uuid.uuid4().hex}"
    facts = spark.range(1).select(
        F.lit("toxic_comment_classifier").alias("model_type"), F.lit("LogisticRegression").alias("algorithm")
    )
    save_model(model, facts, path)
    loaded, metadata = load_model(spark, path)
    texts = views.comments(spark, sf).select("comment_id", "comment_text")
    held_out = texts.join(prepared.test.select("comment_id"), "comment_id")
    algorithm = metadata.select("algorithm").scalar()
    return score(held_out, loaded).drop("comment_text").withColumn("algorithm", algorithm)


@check("a9_model_versions", query([COMMENTS, SPLIT], "SELECT comment_id, TRUE AS same, TRUE AS ruled FROM split WHERE is_test"))
def a9_versions(spark, sf):
    """Held-out comments scored by a model before it was published, and by whoever follows its versions after."""
    prepared = prepare_vectors(views.comments(spark, sf))
    model = as_pipeline(prepared.stages, fit_logistic(prepared.train))
    path = _fresh(spark, "models")
    facts = spark.range(1).select(F.lit("LogisticRegression").alias("algorithm"))
    texts = views.comments(spark, sf).select("comment_id", "comment_text")
    held_out = texts.join(prepared.test.select("comment_id"), "comment_id")
    publish_model(model, facts, path)
    scores, flags = [f"{label}_prob" for label in LABELS], [f"{label}_pred" for label in LABELS]
    said = F.array(*scores, *(F.col(flag).cast("double") for flag in flags))
    before = score(held_out, model).select("comment_id", said.alias("before"))
    after = ModelFollower(spark, path)(held_out)
    ruled = [F.col(p).between(0, 1) & (F.col(f) == (F.col(p) > 0.5)) for p, f in zip(scores, flags, strict=True)]
    rows = after.select("comment_id", said.alias("after"), F.forall(F.array(*ruled), lambda x: x).alias("ruled"))
    return rows.join(before, "comment_id").select("comment_id", (F.col("before") == F.col("after")).alias("same"), "ruled")
