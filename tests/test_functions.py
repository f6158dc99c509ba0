"""Text, label and value functions on cases worked out by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from modlytics.functions import labels as lb
from modlytics.functions import text as tx
from modlytics.functions import values as vl
from modlytics.schema import LABELS


def one(spark, column, value="x", kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Hello World!", "hello world"),
        ("Test@#$123", "test"),
        ("", ""),
        (None, ""),
        ("café naïve", "caf na ve"),
        ("İstanbul", "i stanbul"),
        ("a b c\td\ne", "a b c d e"),
        ("ΣΣ", ""),
        ("  spaced   out  ", "spaced out"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, tx.clean_text(F.col("v")), raw) == clean


def test_lengths_and_previews(spark):
    assert one(spark, tx.text_length(F.col("v")), "añ😀") == 3
    assert one(spark, tx.text_length(F.col("v")), None) is None
    assert one(spark, tx.text_length(F.col("v"), null_as_zero=True), None) == 0
    assert one(spark, tx.preview(F.col("v")), "a" * 100) == "a" * 100
    assert one(spark, tx.preview(F.col("v")), "a" * 101) == "a" * 100 + "..."
    assert one(spark, tx.preview(F.col("v"), 20, always=True), "short") == "short..."


def test_tokens_stop_words_and_ngrams(spark):
    def tokens(raw):
        df = spark.createDataFrame([(raw,)], "v string")
        df = df.select(tx.remove_stop_words(tx.tokenize(F.col("v"))).alias("t"))
        return df.select("t", tx.ngrams(F.col("t"), 1, 2).alias("g"), tx.ngrams(F.col("t"), 1, 3).alias("h")).first()

    row = tokens("the cat a sat on the cat mat")
    assert row.t == ["cat", "sat", "cat", "mat"]
    assert row.g == ["cat", "sat", "cat", "mat", "cat sat", "sat cat", "cat mat"]
    assert row.h[7:] == ["cat sat cat", "sat cat mat"]
    assert tokens("the").g == [] and tokens("").g == [] and tokens("cat").g == ["cat"]
    assert one(spark, tx.remove_stop_words(tx.tokenize(F.col("v")), []), "the cat") == ["the", "cat"]


def test_stop_words_are_sparks_without_apostrophes(spark):
    from pyspark.ml.feature import StopWordsRemover

    known = StopWordsRemover.loadDefaultStopWords("english")
    assert sorted(tx.STOP_WORDS) == sorted(word for word in known if "'" not in word)


@pytest.mark.parametrize(
    "value, places, expected",
    [(0.0625, 3, 0.062), (0.1875, 3, 0.188), (0.5, 0, 0.0), (1.5, 0, 2.0), (0.82345, 4, 0.8234), (-0.0625, 3, -0.062)],
)
def test_round_half_even(spark, value, places, expected):
    assert one(spark, vl.round_half_even(F.col("v"), places), value, "double") == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-01 10:20:30,054", datetime.datetime(2024, 3, 1, 10, 20, 30, 54000)),
        ("2024-03-01T10:20:30.123456+00:00", datetime.datetime(2024, 3, 1, 10, 20, 30, 123456)),
        ("2024-03-01T12:20:30+02:00", datetime.datetime(2024, 3, 1, 10, 20, 30)),
        ("2024-03-01T10:20:30", datetime.datetime(2024, 3, 1, 10, 20, 30)),
        ("yesterday", None),
        (None, None),
    ],
)
def test_parse_ts(spark, text, expected):
    stamp = F.date_format(vl.parse_ts(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    shown = one(spark, stamp, text)
    assert shown == (expected and expected.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_parse_ts_does_not_depend_on_order(spark):
    rows = [("2024-03-01 10:20:30,054",), ("2024-03-01T10:20:30+00:00",)]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "v string")
        assert df.filter(vl.parse_ts(F.col("v")).isNull()).count() == 0


def test_event_date_is_a_utc_day(spark):
    day = vl.event_date(vl.parse_ts(F.col("v"))).cast("string")
    assert one(spark, day, "2024-03-01T23:30:00-02:00") == "2024-03-02"


def test_label_functions(spark):
    df = spark.createDataFrame(
        [({"toxic": True, "insult": True, "threat": False},), ({},), (None,)], "m map<string,boolean>"
    )
    rows = df.select(
        lb.map_get("m", "toxic", False).alias("toxic"),
        lb.positive_labels("m").alias("names"),
        lb.invert_labels("m").alias("inverted"),
        *lb.flatten_labels("m", "_flag", None),
    ).collect()
    assert [row.toxic for row in rows] == [True, False, False]
    assert rows[0].names == "toxic, insult"
    assert rows[0].inverted == {"toxic": False, "insult": False, "threat": True}
    assert rows[0].insult_flag is True and rows[0].obscene_flag is None and rows[2].toxic_flag is None
    titles = [one(spark, lb.label_title(F.col("v")), label) for label in LABELS]
    assert titles == ["Toxic", "Severe Toxic", "Obscene", "Threat", "Insult", "Identity Hate"]


def test_label_equality_and_maximum(spark, scored):
    full = {label: label == "toxic" for label in LABELS}
    df = spark.createDataFrame(
        [(full, dict(full)), (full, {**full, "threat": True}), (full, {})],
        "a map<string,boolean>, b map<string,boolean>",
    )
    assert [r.same for r in df.select(lb.labels_equal("a", "b").alias("same")).collect()] == [True, False, False]
    from modlytics.schema import pred_cols, prob_cols

    top = scored.select(
        "comment_id", lb.max_label_probability(prob_cols()).alias("top"),
        lb.label_count(pred_cols()).alias("n"), lb.is_any_label(pred_cols()).alias("any"),
        F.map_keys(lb.label_map(prob_cols())).alias("keys"),
    ).orderBy("comment_id").collect()
    assert [(r.top, r.n, r.any) for r in top] == [(0.8, 2, True), (0.1, 0, False), (0.95, 4, True)]
    assert top[0]['keys'] == list(LABELS)


def test_times_are_utc_in_any_session_zone(spark):
    from pyspark.sql import functions as F

    from modlytics.functions.values import event_date, iso_utc, parse_ts

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            texts = ["2024-03-01 00:30:00,054", "2024-03-01T00:30:00", "2024-03-01T00:30:00+02:00", "1970-01-01 00:00:00", "no time"]
            times = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_ts(F.col("t")).alias("ts"))
            found.append([(r.i, str(r.d)) for r in times.select(iso_utc(F.col("ts")).alias("i"), event_date(F.col("ts")).alias("d")).collect()])
        assert found[0] == found[1]
        assert found[0][0] == ("2024-03-01T00:30:00.054000+00:00", "2024-03-01")
        assert found[0][2] == ("2024-02-29T22:30:00.000000+00:00", "2024-02-29")
        assert found[0][3] == ("1970-01-01T00:00:00.000000+00:00", "1970-01-01") and found[0][4] == (None, "None")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
