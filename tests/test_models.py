from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from modlytics.operators import boosting, evaluation, features, forests, training
from modlytics.plans.training import run_metrics, run_training
from modlytics.schema import LABELS
from modlytics.sources.models import load_model


def truth(spark, rows):
    """Rows of (six labels, six scores); a flag is a score above one half."""
    names = ", ".join([f"{n} int" for n in LABELS] + [f"{n}_prob double" for n in LABELS])
    df = spark.createDataFrame([(*t, *map(float, p)) for t, p in rows], names)
    return df.withColumns({f"{n}_pred": F.col(f"{n}_prob") > 0.5 for n in LABELS})


def brute_auc(pairs):
    pos = [s for s, t in pairs if t == 1]
    neg = [s for s, t in pairs if t != 1]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_two_documents(spark):
    rows = [((1, 0, 1, 0, 1, 0), (0.8,) * 6), ((0, 1, 0, 1, 0, 1), (0.1,) * 6)]
    aucs = {r.label: r.roc_auc for r in evaluation.label_roc_auc(truth(spark, rows)).collect()}
    assert [aucs[label] for label in LABELS] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    metrics = {(r.metric, r.label): r.value for r in evaluation.evaluate(truth(spark, rows), truth(spark, rows)).collect()}
    assert metrics["mean_auc", "all"] == 0.5 and metrics["exact_match_accuracy", "all"] == 0.0
    assert metrics["accuracy", "toxic"] == 1.0 and metrics["accuracy", "threat"] == 0.0
    names = {r.name for r in evaluation.metric_names(evaluation.evaluate(truth(spark, rows))).collect()}
    assert {"toxic_accuracy", "identity_hate_auc", "mean_auc", "exact_match_accuracy"} <= names


def test_auc_with_ties_close_scores_and_one_class(spark):
    rng = random.Random(5)
    scores = [0.0, 1.0, 0.5, 0.25 + 1e-12, 0.25, 0.25 - 1e-12, 1e-9, 3e-6, 0.999999]
    rows = []
    for _ in range(400):
        picked = [rng.choice(scores) if rng.random() < 0.6 else rng.random() for _ in LABELS]
        rows.append((tuple(int(rng.random() < 0.3) for _ in LABELS[:-1]) + (0,), tuple(picked)))
    df = truth(spark, rows)
    got = {r.label: r.roc_auc for r in evaluation.label_roc_auc(df).collect()}
    for i, label in enumerate(LABELS):
        assert got[label] == pytest.approx(brute_auc([(p[i], t[i]) for t, p in rows]), abs=1e-12)
    assert got["identity_hate"] == 0.0
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="toxic_prob", labelCol="toxic", numBins=0)
    assert got["toxic"] == pytest.approx(evaluator.evaluate(df))


def test_model_choice(spark):
    runs = spark.createDataFrame(
        [("model_a", 0, 0.85), ("model_b", 1, 0.92), ("model_c", 2, 0.88), ("model_d", 3, 0.92)],
        "model_name string, position int, mean_auc double",
    )
    assert evaluation.require_best(runs).model_name == "model_b"
    with pytest.raises(ValueError, match="No models were trained successfully"):
        evaluation.require_best(runs.limit(0))
    summary = evaluation.training_summary(
        runs.withColumn("algorithm", F.upper("model_name")).withColumn("exact_match_accuracy", F.lit(0.5))
    ).first()
    assert (summary.total_models_trained, summary.best_model, summary.best_algorithm) == (4, "model_b", "MODEL_B")


def test_report_falls_back_without_a_run(spark):
    models = spark.createDataFrame([("v1", "r1"), ("v2", "r2")], "model_version string, run_id string")
    runs = spark.createDataFrame([("r1", "A", 0.9, 0.8, "d")],
                                 "run_id string, algorithm string, mean_auc double, exact_match_accuracy double, dataset_id string")
    profile = spark.createDataFrame([("d", 10, 8)], "dataset_id string, row_count bigint, column_count int")
    rows = {r.model_version: r for r in evaluation.model_report(models, runs, profile).collect()}
    assert rows["v1"].row_count == 10 and rows["v1"].status is None
    assert rows["v2"].note == "Detailed metrics not available" and rows["v2"].algorithm is None


def test_class_weights(comments):
    rows = {(r.label, r.value): r.weight for r in training.class_weights(comments).collect()}
    assert rows["toxic", 1] == 6 / 4 and rows["toxic", 0] == 6 / 8 and rows["threat", 1] == 3.0
    weights = {r.comment_id: r.weight for r in training.balanced_weights(comments, "threat").collect()}
    assert weights["3"] == 3.0 and weights["1"] == 0.6 and len(weights) == 6
    alone = training.balanced_weights(comments.filter("toxic = 0"), "toxic").collect()
    assert {r.weight for r in alone} == {0.5} and len(alone) == 4


WORDS = {0: "kind calm gentle friendly warm", 1: "awful nasty vile horrid cruel"}


@pytest.fixture(scope="module")
def separable(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        toxic = int(i % 3 == 0)
        text = " ".join(rng.choice(WORDS[toxic].split()) for _ in range(8))
        rows.append((str(i), text, toxic, 0, toxic, toxic, int(i % 2 == 0), 0))
    names = ", ".join(f"{label} int" for label in LABELS)
    return spark.createDataFrame(rows, f"comment_id string, comment_text string, {names}")


def test_vectors_equal_the_tables(spark, separable):
    docs = separable.unionByName(
        spark.createDataFrame([("none", "!!!")], "comment_id string, comment_text string"), allowMissingColumns=True
    )
    stages = training.feature_stages(docs)
    vectors = training.to_vectors(docs, stages)
    assert vectors.count() == 121
    empty = vectors.filter("comment_id = 'none'").first().features
    assert empty.numNonzeros() == 0 and empty.size == len(training.vocabulary_of(stages))
    terms = features.document_terms(docs)
    weights = features.l2_normalize(features.tfidf(terms, features.build_vocabulary(terms, docs)))
    want = {(r.comment_id, r.term): r.weight for r in weights.collect()}
    got = {(r.comment_id, r.term): r.weight for r in training.vector_terms(vectors, stages).collect()}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key]) for key in want)
    with pytest.raises(ValueError, match="Empty vocabulary"):
        training.feature_stages(docs.limit(0))


def test_training_run(spark, separable, folder):
    few = {"random_forest": {"trees": 5, "depth": 3}, "boosted_trees": {"rounds": 2, "depth": 2}}
    run = run_training(separable, folder, params=few)
    runs = {r.model_name: r for r in run.runs.collect()}
    assert set(runs) == {config.name for config in training.CONFIGS}
    assert runs["logistic_regression"].training_accuracy > 0.4
    assert run.summary.first().best_model == run.best_name
    model, facts = load_model(spark, f"{folder}/best")
    assert facts.first().algorithm == runs[run.best_name].algorithm
    new = spark.createDataFrame([("x", "vile nasty cruel"), ("y", "kind warm calm"), ("z", None)],
                                "comment_id string, comment_text string")
    scored = {r.comment_id: r for r in training.score(new, model).collect()}
    assert scored["x"].toxic_pred and not scored["y"].toxic_pred
    # A label that is never set gets a constant model instead of none.
    assert scored["x"].severe_toxic_prob == scored["y"].severe_toxic_prob < 0.5
    assert set(scored) == {"x", "y", "z"}


def test_scores_survive_saving_and_importance_points_the_right_way(spark, separable, folder):
    from modlytics.operators.training import as_pipeline
    from modlytics.sources.models import save_model

    prepared = training.prepare_vectors(separable)
    models = training.fit_logistic(prepared.train)
    pipeline = as_pipeline(prepared.stages, models)
    save_model(pipeline, spark.range(1).select(F.lit("LogisticRegression").alias("algorithm")), folder)
    loaded, _ = load_model(spark, folder)
    before = {r.comment_id: r.toxic_prob for r in training.score(separable, pipeline).collect()}
    after = {r.comment_id: r.toxic_prob for r in training.score(separable, loaded).collect()}
    assert before == after
    direct = {r.comment_id: r.toxic_prob for r in training.score_vectors(prepared.test, models).collect()}
    assert all(before[key] == pytest.approx(value) for key, value in direct.items())

    rows = training.feature_importance(models[0], training.vocabulary_of(prepared.stages), k=3, spark=spark).collect()
    top = {r.feature for r in rows if r.direction == "toxic"}
    bottom = {r.feature for r in rows if r.direction == "non_toxic"}
    assert top <= set(WORDS[1].split()) and bottom <= set(WORDS[0].split())
    assert [r.position for r in rows] == [0, 1, 2, 0, 1, 2]
    forest = training.fit_labels(prepared.train, training.CONFIGS[1], labels=("toxic",), trees=3, depth=2)[0]
    trees = training.feature_importance(forest, training.vocabulary_of(prepared.stages), k=3, spark=spark).collect()
    assert {r.direction for r in trees} == {"toxic"} and len(trees) == 3


def test_a_failed_fit_is_skipped(separable):
    def broken(label, total, seed=42):
        raise RuntimeError("no")

    prepared = training.prepare_vectors(separable)
    bad = training.ModelConfig("bad", "Bad", broken)
    good = training.ModelConfig("good", "LogisticRegression", training.logistic, {"max_iter": 2})
    assert list(training.train_all(prepared, (bad, good))) == ["good"]
    with pytest.raises(ValueError, match="No models were trained successfully"):
        training.train_all(prepared, (bad,))


def test_a_failed_fit_does_not_look_like_a_result(spark, separable, folder):
    def broken(label, total, seed=42):
        raise RuntimeError("no")

    prepared = training.prepare_vectors(separable)
    bad = training.ModelConfig("bad", "Bad", broken)
    good = training.ModelConfig("good", "LogisticRegression", training.logistic, {"max_iter": 2})
    trained = training.train_all(prepared, (bad, good))
    assert {name: str(error) for name, error in trained.failed.items()} == {"bad": "no"}
    with pytest.raises(ValueError, match="No models of bad"):
        run_metrics(prepared, trained, configs=(bad, good))
    assert run_metrics(prepared, trained, configs=(bad, good), skip_failed=True).select("model_name").distinct().count() == 1
    with pytest.raises(RuntimeError, match="bad training failed"):
        training.train_all(prepared, (good, bad), skip_failed=False)
    with pytest.raises(RuntimeError, match="bad training failed"):
        run_training(separable, folder, configs=(good, bad))
    assert not os.listdir(folder)
    run = run_training(separable, folder, configs=(good, bad), skip_failed=True)
    assert (run.best_name, list(run.failed)) == ("good", ["bad"])


def test_tree_fits_get_partitions_of_bounded_rows(spark, separable):
    train = training.prepare_vectors(separable).train.coalesce(1)
    width, rows = train.first().features.size, train.count()
    sizes = lambda df: [len(part) for part in df.rdd.glom().collect()]
    assert sizes(training.tree_rows(train)) == [rows]
    dealt = training.tree_rows(train, cells=width * 20)
    # Dealing out may miss an even share by a row.
    assert sum(sizes(dealt)) == rows and max(sizes(dealt)) <= 21
    ids = lambda df: sorted(row.comment_id for row in df.collect())
    assert ids(dealt) == ids(train)
    assert training.tree_rows(train.limit(0)).count() == 0
    assert [config.trees for config in training.CONFIGS] == [False, True, True]


def test_boosted_trees_of_several_labels_are_sparks(spark):
    """Same trees as Spark's own fit of each label, whatever the layout of the rows; also with dense and empty vectors."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        values = {place: rng.choice([-1.0, 0.5, rng.random() * 3]) for place in range(9) if rng.random() < 0.4}
        pull = 2 * values.get(1, 0.0) - values.get(4, 0.0) + rng.gauss(0, 1)
        vector = Vectors.sparse(9, values) if i % 5 else Vectors.dense([values.get(place, 0.0) for place in range(9)])
        rows.append((i, vector, int(pull > 0.5), int(pull + values.get(7, 0.0) > 1.5), 0))
    train = spark.createDataFrame(rows, ["id", "features", "toxic", "insult", "threat"]).repartition(3)
    few = {"rounds": 4, "depth": 3}
    labels = ("toxic", "threat", "insult")
    models = training.fit_labels(train, training.CONFIGS[2], labels=labels, **few)
    again = training.fit_labels(train.coalesce(1), training.CONFIGS[2], labels=labels, **few)
    assert not hasattr(models[1], "trees")
    for label, model, other in (("toxic", models[0], again[0]), ("insult", models[2], again[2])):
        data = train.withColumn(label, F.col(label).cast("double"))
        own = training.boosted(label, 400.0, **few).fit(data)
        assert model.getNumTrees == 4 and model.treeWeights == own.treeWeights
        assert model.toDebugString.split("\n")[1:] == other.toDebugString.split("\n")[1:]
        for tree, want in zip(model.trees, own.trees):
            assert tree.numNodes == want.numNodes and tree.depth == want.depth
        # Where gains are equal Spark's choice follows the order of its sums, so a few rows may stand on another side.
        told, wanted = (
            {r.id: r.probability[1] for r in m.setProbabilityCol("probability").setRawPredictionCol("raw").setPredictionCol("p").transform(train).collect()}
            for m in (model, own)
        )
        assert told.keys() == wanted.keys() and sum(abs(told[i] - wanted[i]) > 1e-9 for i in wanted) <= 12
        assert told == pytest.approx(wanted, abs=0.02)
        assert model.featureImportances.toArray().sum() == pytest.approx(1)


def test_boosted_trees_of_few_set_features_cost_no_jobs_a_round(spark, monkeypatch):
    """One task grows a label's trees, the same as ranges of features do, and no job belongs to a round."""
    rng = random.Random(4)
    rows = []
    for i in range(500):
        values = {place: rng.choice([-2.0, -0.5, 0.0, rng.random()]) for place in range(30) if rng.random() < (0.9 if place < 3 else 0.1)}
        pull = values.get(0, 0.0) + values.get(5, 0.0) + rng.gauss(0, 0.5)
        rows.append((Vectors.sparse(30, values), int(pull > 0), int(values.get(2, 0.0) > 0.3), int(rng.random() < 0.02)))
    train = spark.createDataFrame(rows, ["features", "toxic", "insult", "threat"]).repartition(5).cache()
    labels = ("toxic", "insult", "threat")

    def fitted(group: str, rounds: int) -> list[str]:
        spark.sparkContext.setJobGroup(group, group)
        models = training.fit_labels(train, training.CONFIGS[2], labels=labels, rounds=rounds, depth=4)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return [model.toDebugString.split("\n", 1)[1] for model in models]

    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    train.count()
    fitted("two rounds", 2)
    alone = fitted("five rounds", 5)
    assert jobs("two rounds") == jobs("five rounds") > 0
    for name, value in (("PIECE", 100), ("SPARSE", 1), ("SPARSE", 10**6)):
        monkeypatch.setattr(boosting, name, value)
        assert fitted("pieces", 5) == alone
    monkeypatch.setattr(boosting, "ALONE", 0)
    assert fitted("ranges", 5) == alone


def test_chosen_thresholds():
    """Few values: all middles, with the unset rows' zero; many: those nearest to equal shares."""
    told = boosting.chosen(np.array([-1.0, 2.0]), np.array([1, 3]), 10.0, 31)
    assert told.tolist() == [-0.5, 1.0]
    assert boosting.chosen(np.array([5.0]), np.array([4]), 4.0, 31).tolist() == []
    assert boosting.chosen(np.arange(1.0, 9.0), np.ones(8, int), 8.0, 3).tolist() == [2.5, 4.5, 6.5]
    # One value holds most of the rows.
    assert boosting.chosen(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1, 97, 1, 1]), 100.0, 2).tolist() == [1.5, 2.5]


def _set_few(spark, rows: int, size: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        values = {place: rng.choice([-1.0, rng.random() * 3, rng.random()]) for place in range(size) if rng.random() < 0.35}
        pull = 2 * values.get(1, 0.0) - values.get(4, 0.0) + rng.gauss(0, 1)
        vector = Vectors.sparse(size, values) if i % 5 else Vectors.dense([values.get(place, 0.0) for place in range(size)])
        out.append((i, vector, int(pull > 0.5), int(rng.random() < 0.05), 0))
    return spark.createDataFrame(out, ["id", "features", "toxic", "insult", "threat"]).repartition(3).cache()


def test_forests_without_draws_are_sparks(spark):
    """All rows and all features for every tree: the trees of Spark's own fit, with weights and pruning."""
    train = _set_few(spark, 600, 9, 8)

    def make(label, total, seed=42):
        return training.forest(label, total, trees=2, depth=5).setBootstrap(False).setFeatureSubsetStrategy("all")

    told, wanted = (
        training.fit_labels(train, training.ModelConfig("forest", "Forest", make, trees=True, together=together), labels=("insult", "threat", "toxic"))
        for together in (forests.fit_forests, None)
    )
    assert not hasattr(told[1], "trees")
    for model, own in zip((told[0], told[2]), (wanted[0], wanted[2])):
        assert (model.getNumTrees, model.numClasses, model.numFeatures) == (2, 2, 9)
        assert [tree.numNodes for tree in model.trees] == [tree.numNodes for tree in own.trees]
        a, b = (
            {r.id: r.p[1] for r in m.setProbabilityCol("p").setRawPredictionCol("raw").setPredictionCol("flag").transform(train).collect()}
            for m in (model, own)
        )
        # Spark adds weights up in the order of rows, so near equal gains may fall otherwise.
        assert sum(abs(a[i] - b[i]) > 1e-9 for i in b) <= 6
        assert model.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=0.02)


def test_forests_do_not_depend_on_ranges(spark, monkeypatch):
    """Draws of rows and features are the same in every range of features, however many there are and trees grow at a time."""
    train = _set_few(spark, 400, 40, 9)
    fitted = lambda **few: [
        m.toDebugString.split("\n", 1)[1] for m in training.fit_labels(train, training.CONFIGS[1], labels=("toxic", "insult"), trees=7, depth=5, **few)
    ]
    told = fitted()
    assert len(set(told[0].split("Tree "))) == 8
    monkeypatch.setattr(forests, "RANGE", 250)
    monkeypatch.setattr(forests, "PIECE", 30)
    monkeypatch.setattr(forests, "PLACES", 1200)
    assert fitted() == told


def test_bags_and_draws(spark):
    part = forests.Columns(0, *[np.empty(0, int)] * 6, (0, 0), np.ones(5000, np.int8))
    slots, times = forests.bagged(part, range(3, 5), 42, 1.0, True)
    assert abs(times.mean() - 1) < 0.05 and abs((times == 0).mean() - np.exp(-1)) < 0.03
    assert ((slots == 0) == (times > 0)).all() and set(np.unique(slots)) == {-1, 0}
    assert (times[1] == forests.bagged(part, range(4, 5), 42, 1.0, True)[1][0]).all() and (times[0] != times[1]).any()
    assert forests.bagged(part, range(1), 42, 1.0, False)[1].min() == 1
    names = ("auto", "sqrt", "all", "log2", "onethird", "7", "0.25")
    assert [forests.features_per_node(name, 101, 10) for name in names] == [11, 11, 101, 7, 34, 7, 26]
    assert forests.features_per_node("auto", 101, 1) == 101
