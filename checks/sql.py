"""Shared SQL of the oracles: the derived views and the moderation rules."""

from __future__ import annotations

from modlytics.functions.text import STOP_WORDS
from modlytics.plans.views import DERIVED_LABELS, SCORE_TERMS
from modlytics.schema import LABELS

PROBS = [f"{label}_prob" for label in LABELS]
PREDS = [f"{label}_pred" for label in LABELS]
COUNT_PREDS = " + ".join(f"CAST({name} AS INTEGER)" for name in PREDS)
ANY_PRED = " OR ".join(PREDS)
TOP = f"greatest({', '.join(PROBS)})"


def listed(pattern: str, sep: str = ", ") -> str:
    """The pattern once per label, ``{}`` standing for the label."""
    return sep.join(pattern.format(label, l=label) for label in LABELS)


def shown(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def cut(text: str, size: int = 100) -> str:
    return f"CASE WHEN length({text}) > {size} THEN substring({text}, 1, {size}) || '...' ELSE {text} END"


def title(name: str) -> str:
    cases = " ".join(
        f"WHEN '{label}' THEN '{label.replace('_', ' ').title()}'" for label in LABELS
    )
    return f"CASE {name} {cases} END"


def clean(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z]+', ' ', 'g'))"


COMMENTS = "comments AS (SELECT d.doc_id AS comment_id, d.text AS comment_text, d.lang, d.source, l.toxic, " + ", ".join(
    f"CASE WHEN l.toxic = 1 AND d.doc_id % {divisor} = 0 THEN 1 ELSE 0 END AS {label}"
    for label, divisor in DERIVED_LABELS.items()
) + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"

SCORED = "scored AS (SELECT t.*, " + listed(
    "{l}_prob > CAST(0.5 AS DOUBLE) AS {l}_pred"
) + " FROM (SELECT doc_id AS comment_id, text AS comment_text, " + ", ".join(
    f"LEAST(10000, CAST(FLOOR(((doc_id * {factor} + {offset}) % 10007) * (doc_id % 10) / CAST(9 AS DOUBLE)) AS BIGINT)) "
    f"/ CAST(10000 AS DOUBLE) AS {label}_prob"
    for label, (factor, offset) in SCORE_TERMS.items()
) + " FROM documents) t)"

ACTIVITY = """activity AS (SELECT e.event_id, e.ts,
  CASE e.event_type WHEN 'view' THEN '/predict_proba' WHEN 'click' THEN '/predict' WHEN 'purchase' THEN '/feedback'
    WHEN 'signup' THEN '/moderate' ELSE '/moderation-queue/review' END AS endpoint,
  e.value / CAST(1000 AS DOUBLE) AS prediction_latency, e.user_id, e.props, e.value, d.doc_id AS comment_id,
  CASE WHEN length(d.text) > 100 THEN concat(substring(d.text, 1, 100), '...') ELSE d.text END AS request_text
FROM (SELECT ev.*, ev.event_id % k.n AS doc_ref FROM events ev CROSS JOIN (SELECT count(*) AS n FROM documents) k) e
JOIN documents d ON d.doc_id = e.doc_ref)"""

# Activity beside the scores of its document.
CALLS = f"calls AS (SELECT a.*, s.* EXCLUDE (comment_id) FROM activity a JOIN scored s ON a.comment_id = s.comment_id)"

TRUTH = f"truth AS (SELECT c.*, s.* EXCLUDE (comment_id, comment_text) FROM comments c JOIN scored s ON c.comment_id = s.comment_id)"


def decided(source: str, name: str = "decided") -> str:
    """CTE that adds top, n_flags, action, confidence and reasoning to ``source``."""
    shown_top = "printf('%.2f', top)"
    return f"""{name} AS (SELECT *,
  CASE WHEN top >= 0.9 THEN 'reject' WHEN top <= 0.1 THEN 'approve' WHEN n_flags >= 3 THEN 'human_review'
    WHEN top >= 0.7 THEN 'human_review' WHEN top >= 0.3 THEN 'human_review' ELSE 'approve' END AS action,
  CASE WHEN top >= 0.9 THEN top WHEN top <= 0.1 THEN 1 - top WHEN n_flags >= 3 THEN top
    WHEN top >= 0.3 THEN top ELSE 1 - top END AS confidence,
  CASE WHEN top >= 0.9 THEN 'High confidence toxicity detected (max: ' || {shown_top} || ')'
    WHEN top <= 0.1 THEN 'Low toxicity probability (max: ' || {shown_top} || ')'
    WHEN n_flags >= 3 THEN 'Multiple toxicity categories detected (' || n_flags || ' types)'
    WHEN top >= 0.7 THEN 'High confidence toxicity requiring review (max: ' || {shown_top} || ')'
    WHEN top >= 0.3 THEN 'Medium confidence toxicity requiring review (max: ' || {shown_top} || ')'
    ELSE 'Low confidence toxicity (max: ' || {shown_top} || ')' END AS reasoning
  FROM (SELECT *, {TOP} AS top, {COUNT_PREDS} AS n_flags FROM {source}) x)"""


PRIORITY = "CASE WHEN top >= 0.8 THEN 'high' WHEN top >= 0.5 THEN 'medium' ELSE 'low' END"

MODERATED = decided("(SELECT * FROM calls WHERE endpoint = '/moderate') m", "decided") + """,
moderated AS (SELECT *, action = 'human_review' AS review_required,
  CASE WHEN action = 'human_review'
    THEN 'mod_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || md5(CAST(event_id AS VARCHAR)) END AS queue_id FROM decided)"""

QUEUE = f"""queue AS (SELECT queue_id, comment_text AS text, 'forum' AS context, CAST(user_id AS VARCHAR) AS user_id,
  ts AS created_at, {PRIORITY} AS priority, 'pending' AS status, {', '.join(PROBS + PREDS)}
  FROM moderated WHERE action = 'human_review')"""

REVIEWS = """reviews AS (
  SELECT queue_id, CASE WHEN toxic_pred THEN 'reject' ELSE 'approve' END AS action, 'first look' AS moderator_notes,
    ts + INTERVAL 1 HOUR AS reviewed_at FROM moderated WHERE review_required AND value >= 5
  UNION ALL SELECT queue_id, 'warn', NULL, ts + INTERVAL 2 HOUR FROM moderated WHERE review_required AND value >= 20
  UNION ALL SELECT 'mod_unknown_' || event_id, 'approve', 'stray', ts FROM activity
    WHERE endpoint = '/moderation-queue/review')"""

REVIEWED = """reviewed AS (SELECT q.* EXCLUDE (status),
  CASE WHEN r.queue_id IS NULL THEN 'pending' ELSE 'reviewed' END AS status,
  r.action AS final_action, r.moderator_notes, r.reviewed_at
  FROM queue q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY reviewed_at DESC) AS k
    FROM reviews) WHERE k = 1) r ON q.queue_id = r.queue_id)"""

# /predict and /predict_proba rows as the dashboard reads them.
PREDICTIONS = "predictions AS (SELECT event_id, ts, endpoint, length(request_text) AS text_length, " \
    f"({ANY_PRED}) AS is_toxic, CASE WHEN endpoint = '/predict_proba' THEN {TOP} ELSE CAST(0 AS DOUBLE) END AS max_probability, " \
    "prediction_latency, " + listed(
        "CASE WHEN endpoint = '/predict_proba' THEN {l}_prob ELSE CAST(0 AS DOUBLE) END AS {l}_prob, "
        "CASE WHEN endpoint = '/predict' THEN {l}_pred ELSE FALSE END AS {l}_pred"
    ) + " FROM calls WHERE endpoint IN ('/predict', '/predict_proba'))"

FEEDBACK = "feedback AS (SELECT event_id, ts, comment_text, request_text, length(request_text) AS text_length, " \
    "event_id % 4 <> 0 AS is_prediction_correct, " \
    "CASE WHEN event_id % 4 = 0 THEN 'User indicated prediction is wrong - labels inverted' " \
    "ELSE 'User confirmed prediction is correct' END AS user_comments, " + listed(
        "{l}_pred AS {l}_predicted, CASE WHEN event_id % 4 = 0 THEN NOT {l}_pred ELSE {l}_pred END AS {l}_true"
    ) + " FROM calls WHERE endpoint = '/feedback')"

BASE = [SCORED, ACTIVITY, CALLS]


def query(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


STOP_LIST = "[" + ", ".join(f"'{word}'" for word in STOP_WORDS) + "]"

# Tokens, n-grams and term counts of a view with comment_id and comment_text.
def terms(source: str, prefix: str = "") -> list[str]:
    return [
        f"{prefix}tokens AS (SELECT comment_id, list_filter(string_split({clean('comment_text')}, ' '), "
        f"lambda w: length(w) >= 2 AND NOT list_contains({STOP_LIST}, w)) AS tokens FROM {source})",
        f"{prefix}grams AS (SELECT comment_id, unnest(tokens) AS term FROM {prefix}tokens UNION ALL "
        f"SELECT comment_id, tokens[i] || ' ' || tokens[i + 1] FROM (SELECT comment_id, tokens, "
        f"unnest(range(1, len(tokens))) AS i FROM {prefix}tokens))",
        f"{prefix}terms AS (SELECT comment_id, term, count(*) AS tf FROM {prefix}grams GROUP BY ALL)",
    ]


def vocabulary(source: str, prefix: str = "") -> str:
    return f"""vocabulary AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_index FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, any_value(n) AS n_docs
  FROM {prefix}terms CROSS JOIN (SELECT count(*) AS n FROM {source}) GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE) * any_value(n) ORDER BY total DESC, term LIMIT 10000))"""


WEIGHTS = """weights AS (SELECT t.comment_id, t.term, t.tf, v.term_index,
  t.tf * (ln((1 + v.n_docs) / CAST(1 + v.df AS DOUBLE)) + 1) AS weight
  FROM terms t JOIN vocabulary v ON t.term = v.term)"""

NORMAL = """normal AS (SELECT comment_id, term, tf, term_index,
  weight / sqrt(sum(weight * weight) OVER (PARTITION BY comment_id)) AS weight FROM weights)"""

SPLIT = """split AS (SELECT c.*, coalesce(p.place <= q.quota, FALSE) AS is_test FROM comments c
  JOIN (SELECT comment_id, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || comment_id), comment_id) AS place
    FROM comments) p ON c.comment_id = p.comment_id
  JOIN (SELECT toxic, CAST(floor(share) AS BIGINT) + CASE WHEN k <= n_test - floors THEN 1 ELSE 0 END AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, toxic) AS k, sum(floor(share)) OVER () AS floors FROM (
      SELECT toxic, count(*) * any_value(n_test) / any_value(n) AS share, any_value(n_test) AS n_test
      FROM comments CROSS JOIN (SELECT count(*) AS n, ceil(count(*) * CAST(0.2 AS DOUBLE)) AS n_test FROM comments) t
      GROUP BY toxic))) q ON c.toxic = q.toxic)"""

AUC_SQL = """(SELECT CASE WHEN p.n = 0 OR q.n = 0 THEN CAST(0 AS DOUBLE) ELSE s.area / (p.n * q.n) END FROM
  (SELECT sum(pos * (below + neg / 2.0)) AS area FROM (SELECT score, pos, neg,
     coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
     FROM (SELECT {l}_prob AS score, CAST(count(*) FILTER ({l} = 1) AS DOUBLE) AS pos,
       CAST(count(*) FILTER ({l} <> 1) AS DOUBLE) AS neg FROM truth GROUP BY 1))) s,
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM truth WHERE {l} = 1) p,
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM truth WHERE {l} <> 1) q)"""

AUCS = "aucs AS (" + listed("SELECT '{l}' AS label, " + AUC_SQL + " AS roc_auc", " UNION ALL ") + ")"
ACCURACIES = "accuracies AS (" + listed(
    "SELECT '{l}' AS label, CAST(count(*) FILTER ({l}_pred = ({l} = 1)) AS DOUBLE) / count(*) AS accuracy FROM truth",
    " UNION ALL ",
) + ")"
EXACT = "exact AS (SELECT CAST(count(*) FILTER (" + listed("{l}_pred = ({l} = 1)", " AND ") \
    + ") AS DOUBLE) / count(*) AS value FROM truth)"
METRICS = """metrics AS (SELECT 'accuracy' AS metric, label, accuracy AS value FROM accuracies
  UNION ALL SELECT 'roc_auc', label, roc_auc FROM aucs
  UNION ALL SELECT 'exact_match_accuracy', 'all', value FROM exact
  UNION ALL SELECT 'mean_auc', 'all', avg(roc_auc) FROM aucs
  UNION ALL SELECT 'training_accuracy', 'all', value FROM exact)"""
METRIC_CTES = [COMMENTS, SCORED, TRUTH, AUCS, ACCURACIES, EXACT, METRICS]
