import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid import EstimatorExperiment, Experiment, ExperimentConfig, Registry, load_experiment, read_texts
from lexigrid.operators import estimators, explain
from lexigrid.operators.features import FunctionWords, Ngrams
from lexigrid.plans.serve import classify
from lexigrid.operators import naive_bayes
from lexigrid.sources.registry import config_view
from lexigrid.streaming.classify import classify_stream


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, "good fine nice" if i % 3 else "bad awful nice", "pos" if i % 3 else "neg") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    config = ExperimentConfig(
        "moods", "tests", [Ngrams("text", (1,))], alphas=(0.5, 1.0), max_abs=True, proportions=2, lime_docs=2, lime_samples=40
    )
    return config, docs, Experiment(config).run(docs)


def test_tables_of_a_run(fitted):
    config, docs, run = fitted
    assert {r["split"]: r["score"] for r in run.scores.collect()} == {"train": 1.0, "test": 1.0}
    assert {r["split"]: (r["n_rows"], r["n_features"]) for r in run.shapes.collect()} == {"train": (42, 6), "test": (18, 6)}
    assert run.predictions.count() == 60 and run.grid.count() == 2
    assert [r["prop"] for r in run.curve.collect()] == [0.5]
    top = explain.choose_explanation(run.explanations).collect()
    by_word = {(r["doc_id"], r["word"]): r["weight"] for r in top}
    assert by_word[(1, "good")] > by_word[(1, "nice")]


def test_save_twice_load_and_classify(spark, fitted, tmp_path):
    config, docs, run = fitted
    registry = Registry(spark, str(tmp_path / "registry"))
    run.save(registry)
    run.save(registry)
    assert registry.overview().count() == 1
    assert registry.fetch("name", "nobody").count() == 0
    record = registry.fetch("name", "moods").first()
    assert record["clf"] == "MultinomialNB" and record["test_data"] == ["split"] and record["test_score"] == 1.0
    titles = {r["title"]: r["value"] for r in registry.config_view("moods").collect()}
    assert titles["experiment name"] == "moods" and len(titles) == 8
    assert registry.table("log").where("step = '3 report'").count() == 6
    texts = read_texts(spark, ["good nice", "awful", "nothing known"])
    stored = {r["doc_id"]: (r["predicted"], round(r["probability"], 9)) for r in load_experiment(registry, config)(texts).collect()}
    fresh = {r["doc_id"]: (r["predicted"], round(r["probability"], 9)) for r in run.classify(texts).collect()}
    assert stored == fresh and stored[0][0] == "pos" and stored[1][0] == "neg"
    with pytest.raises(KeyError):
        registry.load_model("nobody")


def test_texts_without_features_get_the_class_shares(spark, docs):
    only_functions = FunctionWords(("N",))
    parse = "array<struct<token:string,lemma:string,pos:string,sent:int>>"
    parsed = docs.withColumn(
        "parse",
        F.array(F.struct(F.split("text", " ")[0].alias("token"), F.lit("").alias("lemma"), F.lit("N").alias("pos"), F.lit(0).alias("sent"))),
    )
    model = naive_bayes.fit(only_functions(parsed, ["label"]), parsed)
    empty = read_texts(spark, ["x"]).withColumn("parse", F.array().cast(parse))
    found = classify(empty, model, [only_functions]).first()
    assert found["predicted"] == "pos" and found["proba"]["neg"] == pytest.approx(14 / 40)


def test_external_test_set(spark, docs):
    other = docs.withColumn("doc_id", F.col("doc_id") + 1000).where("label = 'pos'")
    run = Experiment(ExperimentConfig("outside", extractors=[Ngrams("text", (1,))], cv=3)).run(docs, other)
    sizes = {r["split"]: r["count"] for r in run.predictions.groupBy("split").count().collect()}
    assert sizes == {"train": 40, "test": other.count()}


def test_stream_gives_what_a_batch_gives(spark, docs, tmp_path):
    words = Ngrams("text", (1,))
    model = naive_bayes.fit(words(docs, ["label"]), docs)

    def run(batch):
        return classify(batch, model, [words]).select("doc_id", "predicted", "probability")

    source = str(tmp_path / "in")
    docs.repartition(4).write.parquet(source)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    classify_stream(arriving, run, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert streamed.select("batch").distinct().count() == 4
    key = lambda r: (r["doc_id"], r["predicted"], round(r["probability"], 12))
    assert sorted(map(key, streamed.collect())) == sorted(map(key, run(docs).collect()))


def test_local_weights_find_a_linear_model():
    rng = np.random.default_rng(3)
    mask = (rng.random((300, 6)) < 0.6).astype(float)
    mask[0] = 1
    proba = (0.2 + mask @ np.array([0.3, -0.2, 0.0, 0.0, 0.0, 0.1]))[:, None]
    found = dict(explain.local_weights(mask, proba, 3, 25.0, 1e-6)[0])
    assert found == pytest.approx({0: 0.3, 1: -0.2, 5: 0.1}, abs=1e-3)


def test_samples(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "x")], "doc_id bigint, text string")
    drawn = explain.perturb(docs, 20).collect()
    assert len(drawn) == 40
    for r in drawn:
        kept = {w for w, m in zip(r["words"], r["mask"]) if m}
        tokens = {1: ["a", "b", "a", "c"], 2: ["x"]}[r["doc_id"]]
        assert r["text"] == " ".join(t for t in tokens if t in kept)
        assert r["sample"] or len(kept) == len(r["words"])


def test_highlight_and_choice(spark):
    row = spark.createDataFrame(
        [('say "good" or bad', [("good", 0.5), ("bad", -0.1)])], "text string, words array<struct<word:string,weight:double>>"
    )
    text = row.select(explain.highlight(F.col("text"), F.col("words"), ("g", "r"))).first()[0]
    assert text == 'say <b><span style="color:g">good</span></b> or <b><span style="color:r">bad</span></b>'
    rows = spark.createDataFrame(
        [(1, "a", 0.5, "w", 1.0), (1, "b", 0.5, "w", -2.0)], "doc_id int, label string, probability double, word string, weight double"
    )
    assert [tuple(r)[1:] for r in explain.choose_explanation(rows).collect()] == [("b", 0.5, "w", -2.0)]
    assert [r["label"] for r in explain.class_probabilities(rows).orderBy("place").collect()] == ["b", "a"]
    assert explain.weight_series(rows).where("label = 'b'").first()["sign"] == "-"


def test_experiment_with_estimators(spark, docs, tmp_path):
    svm = estimators.Pipe("clf", estimators.linear_svm(1.0, 28, max_iter=5), {"regParam": [0.01, 0.1]})
    forest = estimators.Pipe("clf", estimators.random_forest(5, 3), {"maxDepth": [1]})
    config = ExperimentConfig("stages", extractors=[Ngrams("text", (1,))], cv=2)
    run = EstimatorExperiment(config, [forest, svm]).run(docs)
    assert run.grid.count() == 3 and run.classifier.startswith("LinearSVC(regParam=0.1")
    assert {r["split"]: r["score"] for r in run.scores.collect()} == {"train": 1.0, "test": 1.0}
    assert run.predictions.count() == 40
    found = {r["doc_id"]: r for r in run.classify(read_texts(spark, ["good nice", "awful bad", "zzz"])).collect()}
    assert found[0]["predicted"] == "pos" and found[1]["predicted"] == "neg" and len(found) == 3
    assert sum(found[2]["proba"].values()) == pytest.approx(1)
    registry = Registry(spark, str(tmp_path / "registry"))
    run.save(registry)
    assert registry.fetch("name", "stages").first()["test_score"] == 1.0


def test_names_and_models_side_by_side(spark, docs, tmp_path):
    from lexigrid.operators import naive_bayes
    from lexigrid.sources.registry import Registry, records

    registry = Registry(spark, str(tmp_path / "side"))
    registry.upsert("overview", records(spark, [{"name": n, "clf": "x"} for n in ("007", "7", "2020-01-01")]))
    assert [registry.fetch("name", n).first()["name"] for n in ("007", "7", "2020-01-01")] == ["007", "7", "2020-01-01"]
    many = docs.withColumn("label", F.concat(F.lit("c"), F.col("doc_id") % 20)).withColumn("fold", F.lit(0))
    words = Ngrams("text", (1,))
    registry.save_model("007", naive_bayes.fit(words(docs, ["label"]), docs), ["w"])
    registry.save_model("big", naive_bayes.fit(words(many, ["label", "fold"]), many, folds=3), ["w"])
    assert registry.load_model("007").classes == ("neg", "pos") and len(registry.load_model("big").classes) == 20
    assert registry.load_model("big").merged().sums.count() == registry.load_model("007").sums.count()


@pytest.mark.parametrize("files", [1, 3])
def test_texts_stream_from_a_file_and_from_a_folder(spark, tmp_path, files):
    from lexigrid.catalog.models import classify_best, classify_stream_of_texts

    def store(df, name):
        df.repartition(files).write.parquet(str(tmp_path / ("parts" if files == 1 else "in") / name))
        if files == 1:
            (part,) = (tmp_path / "parts" / name).glob("part-*.parquet")
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / name).write_bytes(part.read_bytes())

    store(spark.createDataFrame([(i, "der die und" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(8)], "doc_id bigint, text string, lang string"), "documents.parquet")
    turns = [(i, k, "user", "the and" if k else f"und der {i}") for i in range(5) for k in range(2)]
    store(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), "conversations.parquet")
    folder = str(tmp_path / "in")
    streamed = sorted(map(tuple, classify_stream_of_texts(spark, folder).collect()))
    assert len(streamed) == 10 and streamed == sorted(map(tuple, classify_best(spark, folder).collect()))
