"""D: sampling, split, text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, r6
from checks.sql import COMMENTS, NORMAL, SPLIT, STOP_LIST, WEIGHTS, clean, query, terms, vocabulary
from modlytics.functions.text import clean_text, ngrams, remove_stop_words, tokenize
from modlytics.operators import features
from modlytics.operators.sampling import sample_rows, stratified_split
from modlytics.operators.training import feature_stages, prepare_features, to_vectors, vector_terms
from modlytics.plans import views
from modlytics.schema import LABELS

LABEL_LIST = ", ".join(LABELS)
FITTED = [COMMENTS, *terms("comments"), vocabulary("comments")]


@check("d1_stratified_split", query([COMMENTS, SPLIT], "SELECT comment_id, toxic, is_test FROM split"))
def d1(spark, sf):
    return stratified_split(views.comments(spark, sf)).select("comment_id", "toxic", "is_test")


@check(
    "d2_sample_rows",
    query(
        [COMMENTS],
        f"SELECT comment_id, comment_text, {LABEL_LIST} FROM comments ORDER BY md5('42:' || comment_id), comment_id LIMIT 100",
    ),
)
def d2(spark, sf):
    return sample_rows(views.comments(spark, sf), 100).select("comment_id", "comment_text", *LABELS)


def _words(spark, sf):
    """All documents; these steps need no label."""
    return views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("comment_id"), tokenize(clean_text(F.col("text"))).alias("tokens")
    )


def _joined(column, name):
    return F.array_join(column, "|").alias(name)


WORDS = f"words AS (SELECT doc_id AS comment_id, list_filter(string_split({clean('text')}, ' '), lambda w: length(w) >= 2) AS tokens FROM documents)"
KEPT = f"kept AS (SELECT comment_id, list_filter(tokens, lambda w: NOT list_contains({STOP_LIST}, w)) AS tokens FROM words)"


@check(
    "d3_tokenize",
    query([WORDS], "SELECT comment_id, len(tokens) AS n, array_to_string(tokens, '|') AS tokens FROM words"),
)
def d3(spark, sf):
    return _words(spark, sf).select(
        "comment_id", F.size("tokens").cast("bigint").alias("n"), _joined("tokens", "tokens")
    )


@check(
    "d4_remove_stop_words",
    query(
        [WORDS, KEPT],
        "SELECT comment_id, len(tokens) AS n, array_to_string(tokens, '|') AS tokens FROM kept",
    ),
)
def d4(spark, sf):
    kept = _words(spark, sf).withColumn("tokens", remove_stop_words(F.col("tokens")))
    return kept.select("comment_id", F.size("tokens").cast("bigint").alias("n"), _joined("tokens", "tokens"))


@check(
    "d5_ngrams",
    query(
        [WORDS, KEPT],
        """SELECT comment_id, len(grams) AS n, array_to_string(grams, '|') AS grams FROM (
  SELECT comment_id, list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS grams
  FROM kept) x""",
    ),
)
def d5(spark, sf):
    tokens = features.document_tokens(views.table(spark, sf, "documents"), "doc_id", "text").select(
        F.col("doc_id").alias("comment_id"), "tokens"
    )
    grams = tokens.select("comment_id", ngrams(F.col("tokens"), 1, 2).alias("grams"))
    return grams.select("comment_id", F.size("grams").cast("bigint").alias("n"), _joined("grams", "grams"))


def _vocabulary(spark, sf):
    comments = views.comments(spark, sf)
    return features.build_vocabulary(features.document_terms(comments), comments)


@check(
    "d6_build_vocabulary",
    query(FITTED, "SELECT term, df, total, n_docs, CAST(term_index AS INTEGER) AS term_index FROM vocabulary"),
)
def d6(spark, sf):
    return _vocabulary(spark, sf)


@check(
    "d7_idf",
    query(
        FITTED,
        "SELECT term, round_even(ln((1 + n_docs) / CAST(1 + df AS DOUBLE)) + 1, 6) AS idf FROM vocabulary",
    ),
)
def d7(spark, sf):
    return features.with_idf(_vocabulary(spark, sf)).select("term", r6("idf").alias("idf"))


@check(
    "d8_tfidf",
    query(
        FITTED + [WEIGHTS],
        "SELECT comment_id, term, tf, CAST(term_index AS INTEGER) AS term_index, round_even(weight, 6) AS weight FROM weights",
    ),
)
def d8(spark, sf):
    terms_of = features.document_terms(views.comments(spark, sf))
    weights = features.tfidf(terms_of, _vocabulary(spark, sf))
    return weights.select("comment_id", "term", F.col("tf").cast("bigint").alias("tf"), "term_index", r6("weight").alias("weight"))


NORMAL_ROWS = "SELECT comment_id, term, round_even(weight, 6) AS weight FROM normal"


@check("d9_l2_normalize", query(FITTED + [WEIGHTS, NORMAL], NORMAL_ROWS))
def d9(spark, sf):
    terms_of = features.document_terms(views.comments(spark, sf))
    weights = features.l2_normalize(features.tfidf(terms_of, _vocabulary(spark, sf)))
    return weights.select("comment_id", "term", r6("weight").alias("weight"))


@check("d10_to_vectors", query(FITTED + [WEIGHTS, NORMAL], NORMAL_ROWS))
def d10(spark, sf):
    """The vectors, read back as rows: the ML stages must agree with the tables."""
    comments = views.comments(spark, sf)
    stages = feature_stages(comments)
    rows = vector_terms(to_vectors(comments, stages), stages)
    return rows.select("comment_id", "term", r6("weight").alias("weight"))


TRAINED = [
    COMMENTS,
    SPLIT,
    "train AS (SELECT * FROM split WHERE NOT is_test)",
    *terms("train", "train_"),
    vocabulary("train", "train_"),
    *terms("comments"),
    WEIGHTS,
    NORMAL,
]


@check(
    "d11_prepare_features",
    query(
        TRAINED,
        """SELECT n.comment_id, s.is_test, n.term, CAST(n.term_index AS INTEGER) AS term_index, n.tf, round_even(n.weight, 6) AS weight
FROM normal n JOIN split s ON n.comment_id = s.comment_id""",
    ),
)
def d11(spark, sf):
    rows = prepare_features(stratified_split(views.comments(spark, sf)))
    return rows.select(
        "comment_id", "is_test", "term", "term_index", F.col("tf").cast("bigint").alias("tf"), r6("weight").alias("weight")
    )
