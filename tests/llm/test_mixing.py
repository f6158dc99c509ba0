from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from modlytics.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes: dict) -> dict:
    """The targets by resharing the excess, round after round."""
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {name: place % 3 + 1 for place, name in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[name] for name in full)
        share = sum(weight[name] for name in names if name not in full)
        target = {name: 3.0 * sizes[name] if name in full else left * weight[name] / share for name in names}
        over = {name for name in names if name not in full and target[name] > 3 * sizes[name]}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    names = ["a", "b", "c", "dé", "z", None, "tiny"]
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(names[:1] * 4 + names[:6])) for k in range(500)]
    rows += [(900, "only three words", "tiny"), (901, None, "tiny"), (902, "", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_sizes_targets_and_takes(docs):
    rows = {r.doc_id: r for r in docs.collect()}
    sizes: Counter = Counter()
    for row in rows.values():
        sizes[row.source] += len(WORD.findall(row.text or ""))
    target, taken = goals(sizes), defaultdict(int)
    out = M.mix_sizes(docs).collect()
    assert len(out) == len(rows)
    for row in out:
        source = rows[row.doc_id].source
        assert row.size == len(WORD.findall(rows[row.doc_id].text or "")) and row.source_size == sizes[source]
        assert row.target == pytest.approx(target[source]) and 0 <= row.taken <= 3 * row.size
        taken[source] += row.taken
    assert all(abs(taken[source] - target[source]) <= 0.5 for source in target)
    again = {r.doc_id: r.taken for r in M.mix_sizes(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_tree_deals_every_block_once_and_evenly(docs):
    settings = M.Settings(block=4, shard=3)
    rows = M.sized(docs, "doc_id", "text", "source", settings)
    goal, mix = M.mixed(rows, settings)
    units = mix.collect()
    assert len({(u.row, u.copy) for u in units}) == len(units)
    shards = Counter(u.shard for u in units)
    assert len(shards) > 8 and max(shards.values()) <= 3 * 4 and sorted(shards) == list(range(len(shards)))
    for shard in list(shards)[:5]:
        assert sorted(u.position for u in units if u.shard == shard) == list(range(shards[shard]))
    total = sum(r.target for r in goal.collect())
    assert sum(u.words for u in units) == pytest.approx(total, abs=4)


def test_hypergeometric_draws(spark):
    sql = M.hypergeometric("g", "t", "k", "(rand(3))")
    row = spark.sql(f"SELECT avg(v) a, stddev(v) s, min(v) l, max(v) h FROM (SELECT {sql} v FROM (SELECT 40L g, 100L t, 30L k FROM range(8000)))").first()
    assert abs(row.a - 12) < 0.15 and abs(row.s - (30 * 0.4 * 0.6 * 70 / 99) ** 0.5) < 0.1 and row.l >= 0 and row.h <= 30
    edge = spark.sql(f"SELECT {M.hypergeometric('g', 't', 'k', '0.5D')} v FROM VALUES (0L, 9L, 3L), (9L, 9L, 3L), (4L, 9L, 9L), (4L, 9L, 0L), (4L, 0L, 0L) AS x(g, t, k)")
    assert [r.v for r in edge.collect()] == [0, 3, 4, 0, 0]


def test_mixed_rows(docs):
    mixed = M.mix_rows(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(M.WORD)))).first()[0]
    assert words == M.mix_sizes(docs).select(F.sum("taken")).first()[0]


def test_texts_stay_whole(spark, docs):
    """Also where most sources have one to three texts and a target within one of them."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{k}" for _ in range(rng.randint(1, 90))), f"s{min(k, rng.randint(0, 120))}") for k in range(150)]
    rows += [(150 + k, " ".join(f"w{k}" for _ in range(400)), "long") for k in range(2)]
    for frame in (docs, spark.createDataFrame(rows, "doc_id bigint, text string, source string")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        times = Counter((r.doc_id, r.text) for r in M.mix_rows(frame).collect())
        assert times and all(texts[key] == text and n <= 3 for (key, text), n in times.items())
        takes = {r.doc_id: r for r in M.mix_sizes(frame).collect()}
        assert all(row.taken == row.size * times[key, texts[key]] for key, row in takes.items())


def test_whole_texts_come_near_the_target(spark):
    """A source of one text takes it as often as is nearest; no source is off by more than half of a text."""
    rng = random.Random(10)
    rows = [(k, " ".join("w" for _ in range(rng.randint(1, 90))), f"s{k % 40 if k < 200 else k}") for k in range(300)]
    groups = defaultdict(list)
    for row in M.mix_sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect():
        groups[rows[row.doc_id][2]].append(row)
    alone = [texts[0] for texts in groups.values() if len(texts) == 1]
    assert len(alone) == 100 and all(abs(r.taken - round(r.target)) <= min(abs(n * r.size - round(r.target)) for n in range(4)) for r in alone)
    for texts in groups.values():
        assert abs(sum(r.taken for r in texts) - round(texts[0].target)) <= max(r.size for r in texts) / 2


def test_no_python_in_the_plan(docs):
    plan = M.mix_sizes(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_awkward_rows(awkward, empty):
    out = M.mix_sizes(awkward).collect()
    assert len(out) == 8 and all(r.taken == 0 for r in out if r.size == 0) and sum(r.doc_id is None for r in out) == 1
    mixed = M.mix_rows(awkward)
    assert mixed.columns == awkward.columns and mixed.filter("text is null").count() == 0
    assert M.mix_sizes(empty).count() == 0 and M.mix_rows(empty).count() == 0
