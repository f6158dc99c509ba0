from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from modlytics.llm.queries import ORACLES, QUERIES


def test_names():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of each kind that a stage decides on."""
    rng = random.Random(7)
    vocab = [f"word{i}" for i in range(5000)]

    def prose(n: int) -> list[str]:
        return [rng.choice(vocab) for _ in range(n)]

    clean = [(k, " ".join(prose(80)), "en", f"s{k % 4}", 0) for k in range(60)]
    base = prose(120)
    near = [(100 + k, " ".join(base[:place] + ["changed"] + base[place + 1 :]), "en", "s1", 0) for k, place in enumerate((5, 50, 100))]
    copies = [(200 + k, clean[0][1], "en", "s2", 0) for k in range(3)]
    bad = [(300, "too short", "en", "s1", 0), (301, " ".join(["again and again"] * 50), "en", "s1", 0), (302, None, "en", "s1", 0)]
    secret = [(400, " ".join(prose(60)) + ' password = "hunter2hunter2" ' + " ".join(prose(20)), "en", "s3", 0)]
    path = tmp_path_factory.mktemp("pipeline")
    frame = spark.createDataFrame(clean + near + copies + bad + secret, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = []
    for _, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, folder))
        found.append(docs)
    kept = {r.doc_id for r in found[0].collect()}
    assert not kept & {300, 301, 302} and len(kept) == 67
    single = {r.doc_id for r in found[1].collect()}
    assert single == set(range(60)) | {100, 400}
    masked = {r.doc_id: r for r in found[2].collect()}
    assert "hunter2" not in masked[400].text and "[secret]" in masked[400].text and masked[400].n_chars == len(masked[400].text)
    assert set(masked) == single and all("[secret]" not in masked[k].text for k in range(60))
    assert all(frame.columns == columns for frame in found[:4])
    assert found[3].filter("text is null").count() == 0 and {r.doc_id for r in found[3].collect()} <= single
    assert found[4].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found[4].count() == found[3].count()


def test_run(spark, folder):
    out = P.run(spark, folder)
    assert out.filter(F.length("decoded_sha256") != 64).count() == 0 and out.count() > 40


def test_awkward_rows_and_no_rows(spark, awkward, empty):
    for docs, rows in ((awkward, 1), (empty, 0)):
        for place, (_, stage) in enumerate(P.STAGES):
            docs = P.stored(stage(spark, docs, "unused"))
            if place < 4:
                assert docs.columns == awkward.columns
            assert docs.count() >= rows or place >= 3


def test_working_tables_go_once_nothing_reads_them(spark):
    from modlytics.llm.common import noted, release

    with noted() as made:
        first = P.stored(spark.range(3))
        second = P.stored(spark.range(5))
    assert len(made) == 2
    release(second, made)
    assert len(made) == 1 and second.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        first.count()


def test_results_of_several_calls_are_held_at_a_time(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    early, late = docs.filter("doc_id < 200"), docs.filter("doc_id >= 200")
    first, second = P.near_dedup(spark, early, folder), P.near_dedup(spark, late, folder)
    third = P.mask_secrets(spark, docs, folder)
    assert first.count() == 61 and third.count() == docs.count()
    assert {r.doc_id for r in second.collect()} >= {200, 400} and first.count() == 61


def test_threads_note_their_own_tables(spark):
    import threading

    from modlytics.llm.common import noted

    with noted() as made:
        other = threading.Thread(target=lambda: P.stored(spark.range(2)))
        other.start()
        other.join()
        P.stored(spark.range(3))
    assert len(made) == 1
