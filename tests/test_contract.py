"""The registered queries: names, columns, plans, and a sample of full comparisons."""

from __future__ import annotations

import glob
import os
import re
import shutil

import duckdb
import pytest

import __spark_entry__ as contract
from checks.verify import oracle, rows

SMALL = "/root/testdata/sf0.001"
# Operators whose result SQL cannot give: fitted models.
WITHOUT_SQL = {
    "a9_save_load_model", "e2_fit_logistic", "e3_fit_forest", "e4_fit_boosted", "e5_train_all",
    "e6_score", "e13_feature_importance",
}
OPERATORS = [f"{group}{i}" for group, n in
             (("a", 9), ("b", 13), ("c", 8), ("d", 11), ("e", 15), ("f", 12), ("g", 17), ("h", 7))
             for i in range(1, n + 1)]


def test_every_operator_is_registered():
    # The queries of the optional pipeline operators have tests of their own.
    own = {name for name in contract.queries() if re.match(r"[a-h]\d", name)}
    assert {name.split("_")[0] for name in own} == set(OPERATORS)
    assert own - set(contract.oracle_sql()) == WITHOUT_SQL


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["action", "priority", "comments", "mean_confidence"]
    assert sum(r.comments for r in frame.collect()) == 200


@pytest.mark.parametrize(
    "name",
    ["a5_read_logs", "b4_parse_ts", "b5_event_date", "c4_validate_training", "d5_ngrams", "g12_length_drift", "c6_validate_requests", "d1_stratified_split", "d9_l2_normalize",
     "e8_label_roc_auc", "f3_moderation_decision", "f8_apply_reviews", "g1_parse_predictions", "g13_length_density",
     "g14_length_summary", "h1_stream_logs", "h2_stream_moderate", "h5_stream_silence", "h6_stream_queue"],
)
def test_sample_of_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = contract.queries()[name](spark, SMALL)
    names, _, data = oracle(con, contract.oracle_sql()[name])
    assert sorted(frame.columns) == sorted(names)
    assert rows(frame.columns, frame.collect()) == rows(names, data)


def plan_of(spark, name):
    return contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["f3_moderation_decision", "g4_daily_toxicity", "d11_prepare_features",
                                  "e8_label_roc_auc", "g9_label_performance", "f8_apply_reviews"])
def test_plans_have_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(spark, name)
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(spark, "e9_exact_match_accuracy")
    assert "text:string" not in plan and "lang:string" not in plan
    assert "PushedFilters" in plan


def test_a_stream_reads_a_table_of_one_file_and_a_folder_of_part_files(spark, folder):
    texts = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    texts.repartition(4).write.parquet(f"{folder}/parts/documents.parquet")
    texts.coalesce(1).write.parquet(f"{folder}/one")
    (part,) = glob.glob(f"{folder}/one/*.parquet")
    os.makedirs(f"{folder}/file")
    shutil.copy(part, f"{folder}/file/documents.parquet")
    found = [
        rows(frame.columns, frame.collect())
        for frame in (contract.queries()["h2_stream_moderate"](spark, f"{folder}/{kind}") for kind in ("parts", "file"))
    ]
    assert len(found[0]) == 40 and found[0] == found[1]
