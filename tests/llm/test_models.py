"""Language identification, toxicity and the language model: held-out accuracy and exact parts."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modlytics.llm import gru, langid, lm, toxicity
from modlytics.llm.common import remainder

PARTS = {"xx": ["tion", "ing", "the", "re"], "yy": ["heit", "ung", "der", "sch"], "zz": ["ción", "que", "los", "ña"]}


def text(rng: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = []
    for key in range(600):
        lang = rng.choice(list(PARTS))
        body = text(rng, lang, rng.randint(10, 80)).split()
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                body.insert(rng.randint(0, len(body)), rng.choice(["vilewort", "nastoid", "grimbo" + rng.choice("abc")]))
        rows.append((key, " ".join(body), lang if key % 9 else None, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").cache()


def test_remainder_is_the_crc_of_the_key_as_text(spark):
    rows = spark.range(50).select("id", remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_languages_of_held_out_texts(docs):
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    assert model.langs == ["xx", "yy", "zz"]
    out = langid.identify(docs, model, ["doc_id", "lang"]).filter("lang is not null")
    held = out.filter(held_out)
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark, docs, awkward, empty):
    model = langid.train(docs, F.lit(True))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "die heitung der schung")]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id int, text string"), model, ["doc_id"]).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "und", "yy"]
    assert out[1].rejected and out[3].score == 0.0
    assert langid.identify(awkward, model, ["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score", "rejected"]
    assert langid.identify(awkward, None, ["doc_id"]).filter("lang_pred = 'und'").count() == 8
    assert langid.train(empty, F.lit(True)) is None and langid.identify(empty, model, ["doc_id"]).count() == 0


def test_chunks_give_the_subwords_of_the_whole():
    rng, small = random.Random(1), langid.Settings(chunk=7)
    for _ in range(20):
        raw = text(rng, "zz", 12).encode()
        whole, parts = (np.sort(np.concatenate(list(langid.subwords(raw, s)))) for s in (langid.Settings(), small))
        assert np.array_equal(whole, parts)


def test_toxicity_of_held_out_texts(docs):
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), ~held_out)
    out = toxicity.score_texts(docs, model, ["doc_id", "toxic"]).filter(held_out)
    right = out.filter("toxic = predicted").count()
    assert right >= 0.97 * out.count() and out.filter("score < 0 or score > 1").count() == 0


def test_toxicity_edges(docs, awkward, empty):
    labels = docs.select("doc_id", "toxic")
    one_class = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)), F.lit(True))
    assert toxicity.score_texts(awkward, one_class, ["doc_id"]).filter("predicted = 0").count() == 8
    untaught = toxicity.train(empty, labels, F.lit(True))
    assert toxicity.score_texts(awkward, untaught, ["doc_id", "score"]).columns == ["doc_id", "score", "predicted"]
    assert toxicity.score_texts(empty, one_class, ["doc_id"]).count() == 0


def test_label_model_trusts_accurate_voters_and_shares_copied_evidence():
    rng = np.random.default_rng(2)
    truth = (rng.random(2000) < 0.3).astype(np.int8)
    def voter(right: float) -> np.ndarray:
        return np.where(rng.random(2000) < right, truth, 1 - truth) * 2 - 1
    good, poor = voter(0.95), voter(0.55)
    votes = np.stack([good, poor, poor, poor, poor], axis=1).astype(np.int8)
    noisy = np.where(rng.random(2000) < 0.05, 1 - truth, truth)
    belief = toxicity.label_model(votes, noisy, toxicity.Settings())
    assert ((belief > 0.5) == (truth > 0)).mean() > 0.95


def tokens(value: str | None) -> list[bytes]:
    return [*(value or "").encode().lower().split(), b""]


def test_language_model_counts_are_exact_and_it_beats_them(docs):
    held_out = remainder(F.col("doc_id"), 7) == 2
    settings = lm.Settings(words=40, known=60, tails=4, warm=300, rounds=8, every=1, batch=16, segment=16, window=16)
    out = {r.doc_id: r for r in lm.score_texts(docs, ~held_out, ["doc_id"], settings=settings).collect()}
    rows = docs.collect()
    counts: Counter = Counter()
    for row in rows:
        if zlib.crc32(str(row.doc_id).encode()) % 7 != 2:
            counts.update(tokens(row.text))
    total, distinct = sum(counts.values()), len(counts)
    base = score = 0.0
    for row in rows:
        words, got = tokens(row.text), out[row.doc_id]
        want = sum(math.log10((counts[word] + 1) / (total + distinct + 1)) for word in words)
        assert got.n_tokens == len(words) and got.n_known == sum(counts[word] > 0 for word in words)
        assert got.train_tokens == total and got.base_score == pytest.approx(want)
        if zlib.crc32(str(row.doc_id).encode()) % 7 == 2:
            base, score = base + want, score + got.score
    assert score > base


def test_language_model_learns_from_every_token(spark):
    """With the settings of op3_lm; each word stands in three places, and an input moves its embedding."""
    rng, settings = random.Random(8), lm.Settings()
    words = [f"w{k}" for k in range(1500)]
    texts = spark.createDataFrame([(" ".join(rng.sample(words, 1500)).encode(),) for _ in range(3)], "text binary").repartition(1)
    known = lm.vocabulary(lm.count_words(texts), settings)
    start = gru.fresh(known.shape, known.frequencies, 1)
    shared, begin = (spark.sparkContext.broadcast(value) for value in (known, gru.packed(start, known.shape)))
    (learner,) = lm.passes(texts, shared, begin, settings).collect()
    moved = (gru.unpacked(learner.weights, known.shape)["embed"] != start["embed"]).any(axis=1)
    assert learner.seen == known.total == 4503 and moved[: known.shape.words].all()


def test_language_model_keeps_what_the_pass_gave(spark, monkeypatch):
    """Whatever it is worth on the texts of the warm-up."""
    settings = lm.Settings(words=8, known=16, tails=2, warm=100, rounds=2, batch=4, segment=16)
    texts = spark.createDataFrame([(b"a b c d e f g",)] * 60, "text binary")
    known = lm.vocabulary(lm.count_words(texts), settings)
    other = gru.packed({name: -5 * value for name, value in gru.fresh(known.shape, known.frequencies, 9).items()}, known.shape)
    monkeypatch.setattr(lm, "averaged", lambda rows, shape: other)
    weights = lm.train(texts, known, spark.sparkContext.broadcast(known), settings)
    assert gru.packed(weights, known.shape) == other


def test_copies_of_a_text_are_drawn_in_their_share(spark):
    texts = spark.createDataFrame([(b"one hot text",)] * 900 + [(b"text %d" % k,) for k in range(900)], "text binary")
    rows = lm.drawn(texts, 1800, lm.Settings(warm=200)).collect()
    hot = sum(bytes(r.text) == b"one hot text" for r in rows)
    assert 60 < hot < 140 and 60 < len(rows) - hot < 140


def test_language_model_edges(awkward, empty):
    settings = lm.Settings(words=8, known=16, tails=2, warm=10, rounds=1, batch=4)
    out = lm.score_texts(awkward, F.lit(True), ["doc_id"], settings=settings).collect()
    assert len(out) == 8 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 4)} == {1}
    untaught = lm.score_texts(awkward, F.lit(False), ["doc_id", "n"], settings=settings).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in untaught)
    assert lm.score_texts(empty, F.lit(True), ["doc_id"], settings=settings).count() == 0


def test_network_chances_sum_to_one_and_gradients_are_right():
    rng = np.random.default_rng(0)
    shape = gru.Shape(10, 3, group=4, width=5)
    weights = {name: value.astype(np.float64) for name, value in gru.fresh(shape, np.ones(13), 1).items()}
    state = rng.standard_normal((1, 5))
    assert sum(np.exp(gru.log_chances(state, np.array([i]), weights, shape)[0][0]) for i in range(13)) == pytest.approx(1)

    class Probe(gru.Trainer):
        def update(self, back):
            self.back = back

    ids = rng.integers(0, 13, (3, 6))
    probe = Probe(weights, shape, 0)
    probe.learn(ids, 0, 6)
    for name, value in weights.items():
        place = tuple(rng.integers(0, n) for n in value.shape)
        kept, told = value[place], []
        for change in (1e-5, -1e-5):
            value[place] = kept + change
            told.append(Probe(weights, shape, 0).learn(ids, 0, 6))
        value[place] = kept
        assert probe.back[name][place] == pytest.approx(-(told[0] - told[1]) / 2e-5, abs=1e-6)


def test_network_state_is_carried_through_the_whole_text():
    rng = np.random.default_rng(4)
    shape = gru.Shape(20, 4, group=8, width=6)
    weights = gru.fresh(shape, np.ones(24), 3)
    texts = [rng.integers(0, 24, n) for n in (0, 1, 300, 7, 300)]
    together = gru.score(texts, 0, weights, shape, buffer=50)
    for ids, got in zip(texts, together, strict=True):
        state, before, want = np.zeros((1, 6), np.float32), 0, 0.0
        entered = weights["embed"] @ weights["enter"] + weights["lean"]
        for i in ids:
            state = gru.step(entered[[before]], state, weights["turn"])[0]
            want += float(gru.log_chances(state, np.array([i]), weights, shape)[0][0])
            before = i
        assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_language_model_reads_texts_as_python_splits_them():
    """All texts at once, with any bytes and from the middle of an array; ids, rare words and pieces."""
    rng = random.Random(1)
    signs = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\xc2\x85", b"\xc2\xa0", b"A", b"b", b"Z", b"\xc3\x89", b"\xff", b"\x00"]
    texts = [b"", b" ", b"  a"] + [b"".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(500)]
    column = pa.array([b"other", *texts], pa.binary()).slice(1)
    split = [[*text.lower().split(), b""] for text in texts]
    listed = [b""] + [word for word, _ in Counter(word for words in split for word in words if word).most_common(20)]
    places = np.arange(len(listed))
    known = lm.Vocabulary(pa.array(listed, pa.binary()), places, places, places, {b"a": 0, b"\xff": 1}, np.ones(3), gru.Shape(len(listed), 3), 1, 1)
    read = known.read(column)
    rare, times, ends = read.rare()
    rare, rank = rare.to_pylist(), {word: place for place, word in enumerate(listed)}
    for at, (words, ids) in enumerate(zip(split, read.texts(), strict=True)):
        assert ids.tolist() == [rank.get(word, len(listed) + known.tail(word)) for word in words]
        found = dict(zip(rare[ends[at] : ends[at + 1]], times[ends[at] : ends[at + 1]].tolist()))
        assert found == Counter(word for word in words if word not in rank)
    assert read.sums(np.ones(len(read.ids), np.int64)).tolist() == [len(words) for words in split]
    pieces = list(lm.parts(column, 100))
    assert len(pieces) > 20 and [text for piece in pieces for text in piece.to_pylist()] == texts
    nothing = known.read(column.slice(0, 0))
    assert len(nothing.ids) == 0 and nothing.texts() == [] and len(nothing.rare()[0]) == 0


def test_network_scores_do_not_depend_on_what_steps_together():
    rng = np.random.default_rng(6)
    shape = gru.Shape(20, 4, group=8, width=6)
    weights = gru.fresh(shape, np.ones(24), 3)
    texts = [rng.integers(0, 24, n) for n in (0, 40, 1, 300, 7, 0, 300, 12)]
    alone = np.concatenate([gru.score([text], 0, weights, shape) for text in texts])
    assert alone[0] == 0
    for together in (1, 3, 512):
        assert gru.score(texts, 0, weights, shape, buffer=50, together=together) == pytest.approx(alone, rel=1e-5)


def test_many_equally_frequent_words_fill_the_vocabulary(spark):
    counts = spark.range(3000).select(F.col("id").cast("string").cast("binary").alias("word"), F.lit(7).cast("bigint").alias("c"))
    taken = lm.frequent(counts, 2000)
    assert 1990 <= len(taken) <= 2000 and taken == [pair for pair in taken if pair[1] == 7] and len(set(taken)) == len(taken)
    more = counts.unionByName(counts.limit(5).withColumn("word", F.concat(F.lit("top"), F.col("word")).cast("binary")).withColumn("c", F.lit(90).cast("bigint")))
    taken = lm.frequent(more, 2000)
    assert len(taken) <= 2000 and sum(c == 90 for _, c in taken) == 5
    assert len(lm.frequent(more, 5000)) == 3005 and lm.frequent(counts.limit(0), 10) == []


def test_carried_columns_of_clashing_names_are_kept(docs):
    extra = docs.limit(3).withColumn("found", F.lit("mine")).withColumn("found_", F.lit("too"))
    out = langid.identify(extra, None, ["doc_id", "found", "found_"])
    assert out.columns == ["doc_id", "found", "found_", "lang_pred", "score", "rejected"]
    assert {(r["found"], r["found_"], r["lang_pred"]) for r in out.collect()} == {("mine", "too", "und")}
