"""G: log parsing, aggregation, monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, r6, shown
from checks.sql import BASE, COMMENTS, FEEDBACK, PREDICTIONS, PREDS, PROBS, iso, listed, query, title
from checks.sql import shown as shown_sql
from checks.f_moderation import RANK, REVIEW_CTES
from modlytics.functions.values import round_half_even
from modlytics.operators import drift, monitor, queue
from modlytics.plans import views


PRED_CTES = BASE + [PREDICTIONS]
FB_CTES = BASE + [FEEDBACK]


def predictions(spark, sf):
    return monitor.parse_predictions(views.logs(spark, sf))


def feedback(spark, sf):
    return monitor.parse_feedback(views.logs(spark, sf))


def reviewed_queue(spark, sf):
    return queue.apply_reviews(views.review_queue(spark, sf), views.reviews(spark, sf))


@check(
    "g1_parse_predictions",
    query(
        PRED_CTES,
        f"""SELECT {iso('ts')} AS "timestamp", {shown_sql('ts')} AS ts, endpoint, CAST(text_length AS INTEGER) AS text_length, is_toxic,
  max_probability, prediction_latency, {', '.join(PROBS + PREDS)} FROM predictions""",
    ),
)
def g1(spark, sf):
    return predictions(spark, sf).withColumn("ts", shown(F.col("ts")))


@check(
    "g2_parse_feedback",
    query(
        FB_CTES,
        f"""SELECT {iso('ts')} AS "timestamp", CAST(text_length AS INTEGER) AS text_length, is_prediction_correct, user_comments, """
        + listed("{l}_predicted, {l}_true, {l}_predicted = {l}_true AS {l}_correct")
        + " FROM feedback",
    ),
)
def g2(spark, sf):
    return feedback(spark, sf)


@check(
    "g3_overview",
    query(
        REVIEW_CTES + [PREDICTIONS, FEEDBACK],
        """SELECT (SELECT count(*) FROM predictions) AS total_predictions,
  (SELECT round_even(100 * CAST(count(*) FILTER (is_toxic) AS DOUBLE) / count(*), 6) FROM predictions) AS toxicity_rate,
  (SELECT round_even(avg(prediction_latency), 6) FROM predictions) AS mean_latency,
  (SELECT count(*) FROM feedback) AS total_feedback,
  (SELECT round_even(100 * CAST(count(*) FILTER (is_prediction_correct) AS DOUBLE) / count(*), 6) FROM feedback) AS user_accuracy,
  (SELECT count(*) FROM reviewed WHERE status = 'pending') AS pending_reviews""",
    ),
)
def g3(spark, sf):
    figures = monitor.overview(predictions(spark, sf), feedback(spark, sf), reviewed_queue(spark, sf))
    return figures.withColumns({n: r6(n) for n in ("toxicity_rate", "mean_latency", "user_accuracy")})


@check(
    "g4_daily_toxicity",
    query(
        PRED_CTES,
        """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (is_toxic) AS toxic_count,
  round_even(CAST(count(*) FILTER (is_toxic) AS DOUBLE) / count(*), 3) AS toxic_rate FROM predictions GROUP BY 1""",
    ),
)
def g4(spark, sf):
    rows = monitor.daily_toxicity(predictions(spark, sf))
    return rows.withColumn("date", F.col("date").cast("string"))


@check(
    "g5_latency_series",
    query(
        PRED_CTES,
        f"SELECT {shown_sql('ts')} AS datetime, prediction_latency FROM predictions WHERE prediction_latency IS NOT NULL",
    ),
)
def g5(spark, sf):
    series = monitor.latency_series(predictions(spark, sf))
    return series.withColumn("datetime", shown(F.col("datetime")))


@check(
    "g6_type_frequency",
    query(
        PRED_CTES,
        "SELECT " + title("label") + " AS toxicity_type, rate AS prediction_rate, n AS count FROM ("
        + listed(
            "SELECT '{l}' AS label, CAST(count(*) FILTER ({l}_pred) AS DOUBLE) / count(*) AS rate, "
            "count(*) FILTER ({l}_pred) AS n FROM predictions",
            " UNION ALL ",
        ) + ") x",
    ),
)
def g6(spark, sf):
    return monitor.type_frequency(predictions(spark, sf))


@check(
    "g7_type_confidence",
    query(
        PRED_CTES,
        "SELECT " + title("label") + " AS toxicity_type, round_even(mean, 6) AS average_probability FROM ("
        + listed("SELECT '{l}' AS label, avg({l}_prob) AS mean FROM predictions", " UNION ALL ")
        + ") x",
    ),
)
def g7(spark, sf):
    rows = monitor.type_confidence(predictions(spark, sf))
    return rows.withColumn("average_probability", r6("average_probability"))


@check(
    "g8_user_accuracy",
    query(
        FB_CTES,
        "SELECT CAST(count(*) FILTER (is_prediction_correct) AS DOUBLE) / count(*) AS user_accuracy FROM feedback",
    ),
)
def g8(spark, sf):
    return monitor.user_accuracy(feedback(spark, sf))


@check(
    "g9_label_performance",
    query(
        FB_CTES,
        "SELECT " + title("label") + """ AS toxicity_type, round_even(ok / n, 3) AS accuracy,
  round_even(CASE WHEN p > 0 THEN tp / p ELSE 0 END, 3) AS precision, round_even(tp / t, 3) AS recall,
  round_even(CASE WHEN p + t > 0 THEN 2 * tp / (p + t) ELSE 0 END, 3) AS f1_score FROM ("""
        + listed(
            "SELECT '{l}' AS label, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ({l}_predicted AND {l}_true) AS DOUBLE) AS tp, "
            "CAST(count(*) FILTER ({l}_predicted) AS DOUBLE) AS p, CAST(count(*) FILTER ({l}_true) AS DOUBLE) AS t, "
            "CAST(count(*) FILTER ({l}_predicted = {l}_true) AS DOUBLE) AS ok FROM feedback",
            " UNION ALL ",
        ) + ") x WHERE t > 0",
    ),
)
def g9(spark, sf):
    return monitor.label_performance(feedback(spark, sf))


@check(
    "g10_confidence_histogram",
    query(
        PRED_CTES + [
            """binned AS (SELECT least(CAST(round(max_probability * 10000) AS BIGINT) // 500, 19) AS bin, count(*) AS n
  FROM predictions GROUP BY 1)"""
        ],
        """SELECT g.bin AS bin, g.bin / CAST(20 AS DOUBLE) AS lower, (g.bin + 1) / CAST(20 AS DOUBLE) AS upper,
  coalesce(b.n, 0) AS rows, g.bin >= 10 AS above_threshold
FROM (SELECT unnest(range(20)) AS bin) g LEFT JOIN binned b ON g.bin = b.bin""",
    ),
)
def g10(spark, sf):
    return drift.confidence_histogram(predictions(spark, sf))


@check(
    "g11_confidence_box",
    query(
        PRED_CTES + [
            """quartiles AS (SELECT is_toxic, count(*) AS n, min(max_probability) AS minimum, quantile_cont(max_probability, 0.25) AS q1,
  quantile_cont(max_probability, 0.5) AS median, quantile_cont(max_probability, 0.75) AS q3, max(max_probability) AS maximum
  FROM predictions GROUP BY is_toxic)"""
        ],
        """SELECT CASE WHEN q.is_toxic THEN 'Toxic' ELSE 'Non-Toxic' END AS prediction, any_value(n) AS rows,
  any_value(minimum) AS minimum, round_even(any_value(q1), 6) AS q1, round_even(any_value(median), 6) AS median,
  round_even(any_value(q3), 6) AS q3, any_value(maximum) AS maximum,
  min(p.max_probability) AS lower_whisker, max(p.max_probability) AS upper_whisker
FROM quartiles q JOIN predictions p ON p.is_toxic = q.is_toxic
  AND p.max_probability BETWEEN q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AND q3 + CAST(1.5 AS DOUBLE) * (q3 - q1)
GROUP BY q.is_toxic""",
    ),
)
def g11(spark, sf):
    box = drift.confidence_box(predictions(spark, sf))
    return box.withColumns({name: r6(name) for name in ("q1", "median", "q3")})


DRIFT = """drift AS (SELECT 'Training Data' AS source, length FROM (SELECT length(comment_text) AS length FROM comments)
  UNION ALL SELECT 'Inference', text_length FROM predictions)"""
DRIFT_CTES = BASE + [COMMENTS, PREDICTIONS, DRIFT]


def length_drift(spark, sf):
    return drift.length_drift(views.comments(spark, sf), predictions(spark, sf))


@check("g12_length_drift", query(DRIFT_CTES, "SELECT source, CAST(length AS INTEGER) AS length FROM drift"))
def g12(spark, sf):
    return length_drift(spark, sf)


@check(
    "g13_length_density",
    query(
        DRIFT_CTES + [
            """stats AS (SELECT source, count(*) AS n, stddev_samp(length) AS sd,
  (quantile_cont(CAST(length AS DOUBLE), 0.75) - quantile_cont(CAST(length AS DOUBLE), 0.25)) / CAST(1.34 AS DOUBLE) AS narrow
  FROM drift GROUP BY source)""",
            """widths AS (SELECT source, n, coalesce(CAST(1.06 AS DOUBLE) * CASE WHEN least(sd, narrow) > 0 THEN least(sd, narrow)
  WHEN sd > 0 THEN sd END * pow(n, CAST(-0.2 AS DOUBLE)), 1) AS width FROM stats)""",
            "ends AS (SELECT min(length) AS low, max(length) AS high FROM drift)",
            "counts AS (SELECT source, length, count(*) AS c FROM drift GROUP BY ALL)",
        ],
        """SELECT source, CAST(step AS INTEGER) AS step, round_even(any_value(x), 6) AS x,
  round_even(sum(c * exp(-(x - length) * (x - length) / (2 * width * width)) / (n * width * sqrt(2 * pi()))), 9) AS density
FROM (SELECT c.source, c.length, c.c, w.n, w.width, g.step, e.low + (e.high - e.low) * g.step / CAST(200 AS DOUBLE) AS x
  FROM counts c JOIN widths w ON c.source = w.source CROSS JOIN ends e CROSS JOIN (SELECT unnest(range(201)) AS step) g) p
GROUP BY source, step""",
    ),
)
def g13(spark, sf):
    return drift.length_density(length_drift(spark, sf)).withColumns(
        {"x": r6("x"), "density": round_half_even(F.col("density"), 9)}
    )


@check(
    "g14_length_summary",
    query(
        DRIFT_CTES + [
            """s AS (SELECT source, count(*) AS n, avg(length) AS mean, stddev_samp(length) AS sd,
  quantile_cont(CAST(length AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(length AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(length AS DOUBLE), 0.75) AS q3 FROM drift GROUP BY source)"""
        ],
        """SELECT source, n, round_even(mean, 6) AS mean, round_even(sd, 6) AS sd, q1, median, q3 FROM s
UNION ALL SELECT 'Difference', i.n - t.n, round_even(i.mean - t.mean, 6), round_even(i.sd - t.sd, 6), i.q1 - t.q1,
  i.median - t.median, i.q3 - t.q3 FROM s i JOIN s t ON i.source = 'Inference' AND t.source = 'Training Data'""",
    ),
)
def g14(spark, sf):
    rows = drift.length_summary(length_drift(spark, sf))
    return rows.withColumns({"mean": r6("mean"), "sd": r6("sd")})


@check(
    "g15_queue_breakdown",
    query(
        REVIEW_CTES,
        """SELECT 'status' AS section, 'Pending' AS name, count(*) FILTER (status = 'pending') AS items FROM reviewed
UNION ALL SELECT 'status', 'Reviewed', count(*) FILTER (status = 'reviewed') FROM reviewed
UNION ALL SELECT 'priority', 'High', count(*) FILTER (status = 'pending' AND priority = 'high') FROM reviewed
UNION ALL SELECT 'priority', 'Medium', count(*) FILTER (status = 'pending' AND priority = 'medium') FROM reviewed
UNION ALL SELECT 'priority', 'Low', count(*) FILTER (status = 'pending' AND priority = 'low') FROM reviewed""",
    ),
)
def g15(spark, sf):
    return queue.queue_breakdown(reviewed_queue(spark, sf))


@check(
    "g15_queue_preview",
    query(
        REVIEW_CTES,
        f"""SELECT substring(queue_id, 1, 20) || '...' AS queue_id, substring(text, 1, 100) || '...' AS text_preview, priority,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created, status
FROM (SELECT * FROM reviewed WHERE status = 'pending' ORDER BY {RANK}, created_at, queue_id LIMIT 10) x""",
    ),
)
def g15_preview(spark, sf):
    return queue.queue_preview(reviewed_queue(spark, sf))


@check(
    "g16_health_alerts",
    query(
        PRED_CTES + [FEEDBACK] + [
            "f AS (SELECT CAST(count(*) FILTER (is_prediction_correct) AS DOUBLE) / count(*) AS share FROM feedback)",
            """p AS (SELECT CAST(count(*) FILTER (is_toxic) AS DOUBLE) / count(*) AS share, count(*) AS n,
  count(*) FILTER (ts > TIMESTAMP '2024-02-01' - INTERVAL 1 DAY) AS recent FROM predictions)""",
        ],
        """SELECT 'error' AS type, 'High' AS severity, 'Overall model accuracy has dropped to ' || printf('%.2f', share * 100)
  || '% (below 80% threshold)' AS message FROM f WHERE share < 0.8
UNION ALL SELECT 'warning', 'Medium', 'Overall model accuracy is ' || printf('%.2f', share * 100) || '% (below 90% target)'
  FROM f WHERE share >= 0.8 AND share < 0.9
UNION ALL SELECT 'warning', 'Medium', 'No predictions made in the last 24 hours' FROM p WHERE n > 0 AND recent = 0
UNION ALL SELECT 'warning', 'Medium', 'High toxicity rate detected: ' || printf('%.2f', share * 100)
  || '% of recent comments flagged as toxic' FROM p WHERE share > 0.5""",
    ),
)
def g16(spark, sf):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return monitor.health_alerts(predictions(spark, sf), feedback(spark, sf), as_of)


@check(
    "g17_feedback_table",
    query(
        FB_CTES,
        "SELECT request_text AS text, is_prediction_correct, " + listed("{l}_true AS is_{l}") + " FROM feedback",
    ),
)
def g17(spark, sf):
    return monitor.feedback_table(views.logs(spark, sf))
