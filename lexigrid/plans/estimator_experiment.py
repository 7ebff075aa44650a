"""Experiments with ``pyspark.ml`` stages instead of naive Bayes."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from lexigrid.operators import estimators, metrics, vectorize
from lexigrid.operators.estimators import Pipe
from lexigrid.operators.features import extract_features
from lexigrid.operators.placement import by_document
from lexigrid.plans.experiment import ExperimentConfig, features_of, split_and_fold
from lexigrid.session import staged
from lexigrid.sources.registry import Registry, records


@dataclass(frozen=True)
class StageModel:
    """A fitted pipeline with the vocabulary and labels it was fitted on."""

    config: ExperimentConfig
    model: PipelineModel
    labels: tuple[str, ...]
    vocabulary: DataFrame

    def classify(self, docs: DataFrame) -> DataFrame:
        """``doc_id, predicted``, and ``proba`` where the classifier has it.

        A text without any known feature is an empty vector.
        """
        c = self.config
        rows = extract_features(by_document(docs), c.extractors, c.cleaner, annotator=c.annotator)
        cells = vectorize.transform(rows, self.vocabulary)
        vectors = estimators.to_vectors(cells, self.vocabulary.count(), docs=docs.select("doc_id"))
        scored = self.model.transform(_input(vectors, c))
        names = F.array(*[F.lit(x) for x in self.labels])
        columns = ["doc_id", F.get(names, F.col("predicted_idx").cast("int")).alias("predicted")]
        if "probability" in scored.columns:
            columns.append(F.map_from_arrays(names, vector_to_array("probability")).alias("proba"))
        return scored.select(*columns)


def _input(vectors: DataFrame, c: ExperimentConfig) -> DataFrame:
    """With scaling, vectors under the name the scaler reads."""
    return vectors.withColumnRenamed("features", "unscaled") if c.max_abs else vectors


def load_estimators(registry: Registry, config: ExperimentConfig) -> StageModel:
    """A stored pipeline; ``config`` names it and brings its extractors, as they are code."""
    found = registry.component("labels", config.name).first()
    if found is None:
        raise KeyError(f"no pipeline stored for {config.name!r}")
    model = PipelineModel.load(registry.path(f"pipelines/{config.name}"))
    return StageModel(config, model, tuple(found["labels"]), registry.component("vocabulary", config.name).drop("name"))


@dataclass(frozen=True)
class FittedEstimators(StageModel):
    """The best pipeline on all training rows, and the results as tables."""

    classifier: str
    predictions: DataFrame
    grid: DataFrame
    scores: DataFrame
    report: DataFrame
    duration: float

    def save(self, registry: Registry) -> None:
        """Store record, vocabulary, predictions and the pipeline itself."""
        c, name = self.config, F.lit(self.config.name)
        test = self.scores.where("split = 'test'").first()
        row = {
            "project": c.project, "name": c.name, "clf": self.classifier.split("(")[0], "clf_full": self.classifier,
            "features": ",".join(str(e) for e in c.extractors),
            "train_data": list(c.train_source) or ["-"], "test_data": list(c.test_source) or ["split"],
            "test_score": test["score"] if test else None, "dur": self.duration,
        }
        registry.upsert("overview", records(self.predictions.sparkSession, [row]))
        spark = self.predictions.sparkSession
        registry.upsert("labels", spark.createDataFrame([(c.name, list(self.labels))], "name string, labels array<string>"))
        registry.upsert("vocabulary", self.vocabulary.withColumn("name", name))
        registry.upsert("predictions", self.predictions.withColumn("name", name))
        self.model.write().overwrite().save(registry.path(f"pipelines/{c.name}"))


@dataclass
class EstimatorExperiment:
    """Searches stages and classifiers given as pipes.

    Stages read ``features`` and ``label_idx``; classifiers write
    ``predicted_idx``.
    """

    config: ExperimentConfig
    pipes: Sequence[Pipe]

    def run(self, docs: DataFrame) -> FittedEstimators:
        started = time.monotonic()
        c = self.config
        is_train = F.col("split") == "train"
        keep = ["label", "split", "fold"]
        sides = split_and_fold(docs, c)
        rows = features_of(docs, sides, c)
        vocabulary = staged(vectorize.fit_vocabulary(rows), "vocabulary")
        cells = vectorize.transform(rows, vocabulary)
        vectors = estimators.to_vectors(cells, vocabulary.count(), docs=sides.select("doc_id", *keep))
        indexer = estimators.label_indexer().fit(sides)
        vectors = _input(indexer.transform(vectors), c)
        train = vectors.where(is_train)
        # a stage of the pipeline, so it is fitted anew in every fold
        scaler = [Pipe("scaler", MaxAbsScaler(inputCol="unscaled", outputCol="features"))] if c.max_abs else []

        found = estimators.cross_validate([*scaler, *self.pipes], train, c.cv, c.seed, c.average)
        table = estimators.grid_scores(found)
        best = max(table, key=lambda r: (r[3], r[0], r[1]))  # the later one on equal scores
        chosen = found[best[0]]
        names = F.array(*[F.lit(x) for x in indexer.labels])

        def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
            label = F.get(names, F.col("predicted_idx").cast("int")).alias("predicted")
            return model.transform(rows).select("doc_id", *keep, label)

        # the best setting, fitted without a fold, predicts the rows of that fold
        setting = chosen.getEstimatorParamMaps()[best[1]]

        def without(j: int) -> PipelineModel:
            return chosen.getEstimator().fit(train.where(F.col("fold") != j), setting)

        parts = [predicted(without(j), train.where(F.col("fold") == j)) for j in range(c.cv)]
        classifiers = [p.stage for p in self.pipes if p.name == "clf"]
        model = chosen.bestModel
        if best[1] != max(range(len(chosen.avgMetrics)), key=lambda j: (chosen.avgMetrics[j], -j)):
            model = chosen.getEstimator().fit(train, setting)
        parts.append(predicted(model, vectors.where(~is_train)))
        preds = staged(reduce(lambda a, b: a.unionByName(b), parts), "predictions")
        spark = docs.sparkSession
        return FittedEstimators(
            c, model, tuple(indexer.labels), vocabulary, f"{estimators.name_of(classifiers[best[0]])}({best[2]})", preds,
            spark.createDataFrame(table, "classifier int, setting int, parameters string, mean_score double"),
            metrics.averaged_f1(preds, c.average, ["split"]),
            metrics.report_with_total(preds, ["split"]),
            round(time.monotonic() - started, 1),
        )
