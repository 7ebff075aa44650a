"""Classifiers that compete, and experiments around them."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from lexigrid.operators import estimators, gaussian, linear, naive_bayes, splits, vectorize
from lexigrid.operators.classifiers import GaussianBayes, LinearMachines, MultinomialBayes, Stages, TrainingSet, compete
from lexigrid.operators.features import Ngrams
from lexigrid.plans.experiment import ExperimentConfig
from lexigrid.plans.search import Search
from lexigrid.session import staged
from lexigrid.sources.readers import read_texts
from lexigrid.sources.registry import Registry

words = Ngrams("text", (1,))


def forest(**grid):
    return Stages([estimators.Pipe("clf", estimators.random_forest(5, 3), grid)])


def logistic():
    """A stage that draws nothing, so that a refit gives the same."""
    stage = LogisticRegression(labelCol="label_idx", predictionCol="predicted_idx", regParam=0.05, tol=1e-9)
    return Stages([estimators.Pipe("clf", stage)])


@pytest.fixture(scope="module")
def noisy(spark):
    """Labels that follow the words, but not always, and a large feature."""
    rng = np.random.default_rng(9)
    rows, sides = [], []
    for i in range(72):
        label = "abc"[i % 3]
        sides.append((i, label, None if i % 9 == 8 else i % 4))
        for f in range(6):
            v = rng.poisson(3.0 if (f % 3 == i % 3) != (rng.random() < 0.25) else 1.0)
            if v:
                rows.append((i, label, sides[-1][2], f"f{f}", float(v) * (100 if f == 0 else 1)))
    features = staged(spark.createDataFrame(rows, "doc_id long, label string, fold int, feature string, value double"), "features")
    return features, staged(spark.createDataFrame(sides, "doc_id long, label string, fold int"), "sides")


def predicted(rows):
    return {r["doc_id"]: r["predicted"] for r in rows.collect()}


@pytest.mark.parametrize("weighting", ["plain", "max_abs", "tf_idf"])
def test_each_classifier_out_of_fold_equals_a_refit(noisy, weighting):
    features, sides = noisy
    options = {} if weighting == "plain" else {weighting: True}
    data = TrainingSet(features, sides, 4, **options)
    for classifier in (MultinomialBayes((0.1, 1.0)), GaussianBayes((1e-9, 1e-2)), LinearMachines((0.5,), tol=1e-5), logistic()):
        found = classifier.search(data)
        oof = staged(found.oof, "oof")
        assert oof.count() == 64 * len(found.settings)
        j = 2  # one fold by hand: without it, the others dealt in another way
        slack = {LinearMachines: 1, Stages: 1}.get(type(classifier), 0)  # where it stops
        fold = F.when(F.col("fold") != j, (F.col("doc_id") % 2).cast("int"))
        alone = TrainingSet(features.withColumn("fold", fold), sides.withColumn("fold", fold), 2, **options)
        asked = sides.where(f"fold = {j}")
        for i in range(len(found.settings)):
            model = classifier.search(alone).model(i)
            want = predicted(model.classify(features.where(f"fold = {j}"), docs=asked))
            got = predicted(oof.where(f"fold = {j} AND setting = {i}"))
            assert sum(got[d] == want[d] for d in want) >= len(want) - slack


def test_the_later_of_equals_wins(spark, docs):
    sides = staged(splits.stratified_folds(docs, 3), "sides")
    features = staged(words(docs.drop("label").join(sides, "doc_id"), ["label", "fold"]), "features")
    data = TrainingSet(features, sides, 3)
    first = compete(data, [MultinomialBayes((0.5, 1.0)), LinearMachines((1.0,)), forest(maxDepth=[2, 3])])
    grid = first.grid.collect()
    assert {r["mean_score"] for r in grid} == {1.0} and {r["rank"] for r in grid} == {1}
    assert first.name == "RandomForestClassifier(maxDepth=3)"
    second = compete(data, [forest(maxDepth=[2]), MultinomialBayes((0.5, 1.0))])
    assert second.name == "MultinomialNB(alpha=1.0)"
    assert [(r["classifier"], r["setting"]) for r in grid] == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]


@pytest.mark.parametrize("last", [lambda: LinearMachines((0.1, 1.0)), lambda: forest(maxDepth=[2])], ids=["machines", "forest"])
def test_whole_experiment(spark, docs, tmp_path, last):
    other = docs.where("doc_id < 12").withColumn("doc_id", F.col("doc_id") + 1000)
    lime = spark.createDataFrame([(1, "good fine nice"), (2, "bad awful")], "doc_id long, text string")
    config = ExperimentConfig(
        "whole", "demo", [words], max_abs=True, cv=2, proportions=2, lime_docs=2, lime_samples=20, lime_source=("lime.csv",), train_source=("train.csv",)
    )
    run = Search(config, [GaussianBayes(), last()]).run(docs, other, lime)
    assert {r["split"]: r["score"] for r in run.scores.collect()} == {"train": 1.0, "test": 1.0}
    assert {r["split"]: r["n_rows"] for r in run.shapes.collect()} == {"train": 40, "test": 12}
    curve = run.curve.collect()
    assert [r["prop"] for r in curve] == [0.5] and curve[0]["train"] > 0.9 and curve[0]["test"] > 0.9
    assert run.predictions.where("label <> predicted").count() == 0 and run.predictions.count() == 52
    found = {r["doc_id"]: r for r in run.classify(read_texts(spark, ["good nice", "awful bad", "zzz", ""])).collect()}
    assert found[0]["predicted"] == "pos" and found[1]["predicted"] == "neg" and len(found) == 4
    assert all(sum(r["proba"].values()) == pytest.approx(1) for r in found.values())
    weights = {(r["doc_id"], r["label"], r["word"]): r["weight"] for r in run.explanations.collect()}
    assert any(w > 0 for (d, label, word), w in weights.items() if d == 2 and label == "neg")
    registry = Registry(spark, str(tmp_path / "registry"))
    run.save(registry)
    row = registry.fetch("name", "whole").first()
    assert row["lime_data"] == ["lime.csv"] and row["lime_data_repr"] == ["good fine nice", "bad awful"] and row["test_score"] == 1.0
    assert row["clf"] == run.classifier.split("(")[0] and len(row["lime_data_comp"]) == 2
    assert registry.component("grid", "whole").count() == run.grid.count()


def test_single_class_is_refused(spark, docs):
    with pytest.raises(ValueError, match="fewer than two labels"):
        Search(ExperimentConfig("one"), [MultinomialBayes()]).run(docs.where("label = 'pos'"))
