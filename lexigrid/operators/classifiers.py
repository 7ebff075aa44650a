"""Classifiers that compete in one search: naive Bayes, linear machines, ``pyspark.ml`` stages.

A classifier is given the feature rows of a training set with folds and answers
with predictions out of fold for every setting of its grid, and with the model
of a setting on all training rows.  How it comes by them is its own business:
naive Bayes leaves a fold out of its sums, linear machines are columns of one
matrix, stages are fitted again.  Scalers belong to the model and never see the
fold that is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Protocol

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators import estimators, gaussian, linear, metrics, naive_bayes, vectorize
from lexigrid.operators.estimators import Pipe
from lexigrid.operators.naive_bayes import softmax
from lexigrid.session import staged


@dataclass
class TrainingSet:
    """``features(doc_id, label, fold, feature, value)`` and ``docs(doc_id, label, fold)``.

    Rows without a fold are no training rows; they only add to the vocabulary.
    Values are divided by their feature's largest one (``max_abs``) or weighted by
    ``tf_idf``, fitted without the fold that is predicted.
    """

    features: DataFrame
    docs: DataFrame
    folds: int
    max_abs: bool = False
    seed: int = 42
    join: dict = field(default_factory=dict)
    tf_idf: bool = False

    def __post_init__(self):
        if self.max_abs and self.tf_idf:
            raise ValueError("values are either scaled or weighted")

    @cached_property
    def idf(self) -> DataFrame:
        """``feature, idf`` without each fold and, last, of all training rows."""
        return staged(vectorize.fit_idf_by_fold(self.features, self.docs, self.folds), "idf")

    @cached_property
    def last_idf(self) -> DataFrame:
        return staged(self.idf.select("feature", F.get("idf", F.lit(self.folds)).alias("idf")), "idf")

    @cached_property
    def _weighted(self) -> tuple[DataFrame, DataFrame]:
        rows, lengths = vectorize.tf_idf_by_fold(self.features, self.idf, **self.join)
        return staged(rows, "weighted"), lengths

    @cached_property
    def weighted(self) -> DataFrame:
        """The feature rows with ``values``, by ``tf_idf``."""
        return self._weighted[0]

    @cached_property
    def lengths(self) -> DataFrame:
        return self._weighted[1]

    def fitted(self, model: "Model") -> "Model":
        """A model of weighted values that weighs what it is given."""
        return WeightedModel(model, self.last_idf, self.join) if self.tf_idf else model

    @cached_property
    def train(self) -> DataFrame:
        return self.docs.where("fold IS NOT NULL AND label IS NOT NULL").select("doc_id", "label", "fold")

    @cached_property
    def labels(self) -> tuple[str, ...]:
        return tuple(sorted(r["label"] for r in self.train.select("label").distinct().collect()))

    @cached_property
    def rows(self) -> DataFrame:
        return self.features.where("fold IS NOT NULL AND label IS NOT NULL")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return staged(vectorize.fit_vocabulary(self.features), "vocabulary")

    @cached_property
    def size(self) -> int:
        return self.vocabulary.count()

    @cached_property
    def cells(self) -> DataFrame:
        """``doc_id, fold, idx, value`` of the training rows."""
        return staged(vectorize.transform(self.rows, self.vocabulary, ["fold"], **self.join), "cells")


@dataclass(frozen=True)
class WeightedModel:
    """A model behind the TF-IDF of all training rows."""

    model: "Model"
    idf: DataFrame
    join: dict = field(default_factory=dict)

    @property
    def classes(self) -> tuple[str, ...]:
        return self.model.classes

    def classify(self, features: DataFrame, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
        every = features.select("doc_id", *keep).distinct() if docs is None else docs
        return self.model.classify(vectorize.tf_idf(features, self.idf, **self.join), keep, every)


class Model(Protocol):
    """A fitted classifier; ``classify`` gives ``doc_id, *keep, proba, predicted, probability``."""

    classes: tuple[str, ...]

    def classify(self, features: DataFrame, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class Searched:
    """A classifier's grid: ``oof`` has ``doc_id, label, fold, setting, predicted``, every row predicted without its fold."""

    name: str
    settings: Sequence[str]
    oof: DataFrame
    model: Callable[[int], Model]


class Classifier(Protocol):
    def search(self, data: TrainingSet) -> Searched: ...


def _results(classes: Sequence[str], proba: Column) -> list[Column]:
    names = F.array(*[F.lit(c) for c in classes])
    return [F.map_from_arrays(names, proba).alias("proba"), F.col("predicted"), F.array_max(proba).alias("probability")]


@dataclass(frozen=True)
class ScoredModel:
    """A naive Bayes of either kind: log scores by class."""

    model: naive_bayes.MultinomialNB | gaussian.GaussianNB
    maxima: DataFrame | None = None
    join: dict = field(default_factory=dict)

    @property
    def classes(self) -> tuple[str, ...]:
        return self.model.classes

    def classify(self, features: DataFrame, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
        if isinstance(self.model, gaussian.GaussianNB):
            scored = gaussian.score(features, self.model, keep, docs, **self.join)
        else:
            if self.maxima is not None:
                features = vectorize.scale_max_abs(features, self.maxima, **self.join)
            scored = naive_bayes.score(features, self.model, keep, docs=docs, **self.join)
        return scored.select("doc_id", *keep, *_results(self.classes, softmax(F.col("scores"))))


@dataclass(frozen=True)
class MultinomialBayes:
    """Multinomial naive Bayes over several smoothing values."""

    alphas: Sequence[float] = (1.0,)

    def search(self, data: TrainingSet) -> Searched:
        inside = F.col("fold").isNotNull()
        if data.tf_idf:
            return self._weighted(data)
        scored, model = naive_bayes.cross_fit(
            data.features, data.docs, data.folds, self.alphas, ["label"], inside, inside & F.col("label").isNotNull(),
            data.max_abs, **data.join,
        )
        place = F.array_position(F.array(*[F.lit(float(a)) for a in self.alphas]), F.col("alpha")).cast("int") - 1
        oof = scored.select("doc_id", "label", "fold", place.alias("setting"), "predicted")
        maxima = staged(model.maxima(), "maxima") if data.max_abs else None

        def chosen(i: int) -> Model:
            return ScoredModel(model.merged().with_alpha(self.alphas[i]), maxima, data.join)

        return Searched("MultinomialNB", [f"alpha={a}" for a in self.alphas], oof, chosen)

    def _weighted(self, data: TrainingSet) -> Searched:
        nested, whole = naive_bayes.fit_weighted(data.weighted, data.docs, data.folds)
        rows = data.weighted.where("fold IS NOT NULL AND label IS NOT NULL")
        rows = rows.withColumn("value", F.get("values", F.col("fold")))
        scored = naive_bayes.score_parts(rows, nested, ["label"], "fold", self.alphas, data.train, **data.join)
        place = F.array_position(F.array(*[F.lit(float(a)) for a in self.alphas]), F.col("alpha")).cast("int") - 1
        oof = scored.select("doc_id", "label", "fold", place.alias("setting"), "predicted")

        def chosen(i: int) -> Model:
            return data.fitted(ScoredModel(whole.with_alpha(self.alphas[i]), None, data.join))

        return Searched("MultinomialNB", [f"alpha={a}" for a in self.alphas], oof, chosen)


@dataclass(frozen=True)
class GaussianBayes:
    """Gaussian naive Bayes over several shares of the largest variance."""

    smoothings: Sequence[float] = (1e-9,)

    def search(self, data: TrainingSet) -> Searched:
        parts, models = [], []
        for i, s in enumerate(self.smoothings):
            rows = data.weighted.where("fold IS NOT NULL AND label IS NOT NULL") if data.tf_idf else data.rows
            scored, model = gaussian.cross_fit(rows, data.train, data.folds, ["label"], s, max_abs=data.max_abs, **data.join)
            parts.append(scored.select("doc_id", "label", "fold", F.lit(i).alias("setting"), "predicted"))
            models.append(model)
        oof = reduce(lambda a, b: a.unionByName(b), parts)
        settings = [f"var_smoothing={s}" for s in self.smoothings]
        return Searched("GaussianNB", settings, oof, lambda i: data.fitted(ScoredModel(models[i].merged(), None, data.join)))


@dataclass(frozen=True)
class MachineModel:
    model: linear.LinearSVM
    join: dict = field(default_factory=dict)

    @property
    def classes(self) -> tuple[str, ...]:
        return self.model.classes

    def classify(self, features: DataFrame, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
        scored = linear.score(features, self.model, keep, docs, **self.join)
        return scored.select("doc_id", *keep, *_results(self.classes, F.col("proba")))


@dataclass(frozen=True)
class LinearMachines:
    """Linear support vector machines over several penalties, all of them fitted together."""

    penalties: Sequence[float] = (1.0,)
    passes: int = 100
    tol: float = 1e-3

    def search(self, data: TrainingSet) -> Searched:
        rows = linear.sparse_rows(data.cells, data.train, ["label", "fold"])
        scale = _maxima(data) if data.max_abs else _inverse_idf(data) if data.tf_idf else None
        if data.tf_idf:
            lengths = data.lengths.select(F.col("doc_id").alias("_id"), "norm")
            none = F.array(*[F.lit(0.0)] * (data.folds + 1))
            rows = rows.join(lengths, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("norm", F.coalesce("norm", none))
            rows = staged(rows, "rows")
        machines = linear.fit_all(rows, data.size, data.labels, data.folds, self.penalties, scale, self.passes, self.tol)
        scored = staged(linear.margins(rows, machines, ["label", "fold"]), "margins")

        def chosen(i: int) -> Model:
            last = scale[-1] if data.tf_idf else None
            return data.fitted(MachineModel(linear.chosen(machines, i, data.vocabulary, scored, last), data.join))

        return Searched("LinearSVM", [f"C={c}" for c in self.penalties], scored.drop("margins"), chosen)


def _maxima(data: TrainingSet) -> np.ndarray:
    """Largest absolute value of every feature outside each fold and, last, of all; 1 where there is none."""
    tops = data.cells.groupBy("idx", "fold").agg(F.max(F.abs("value")).alias("top")).toArrow()  # as large as the weights
    by_fold = np.zeros((data.folds, data.size))
    by_fold[tops["fold"].to_numpy(), tops["idx"].to_numpy()] = tops["top"].to_numpy()
    without = [np.delete(by_fold, j, 0).max(0) if data.folds > 1 else by_fold[0] for j in range(data.folds)]
    found = np.array([*without, by_fold.max(0)])
    return np.where(found > 0, found, 1.0)


def _inverse_idf(data: TrainingSet) -> np.ndarray:
    """What TF-IDF divides values by, before lengths: a row without each fold and, last, of all training rows."""
    table = data.idf.join(data.vocabulary, "feature").select("idx", "idf").toArrow()  # as large as the weights
    found = np.ones((data.folds + 1, data.size))
    found[:, table["idx"].to_numpy()] = 1 / np.array(table["idf"].to_pylist(), np.float64).reshape(-1, data.folds + 1).T
    return found


@dataclass(frozen=True)
class StageClassifier:
    """A fitted pipeline of stages with the labels and vocabulary it was fitted on."""

    model: PipelineModel
    classes: tuple[str, ...]
    vocabulary: DataFrame
    size: int
    max_abs: bool = False
    join: dict = field(default_factory=dict)

    def classify(self, features: DataFrame, keep: Sequence[str] = (), docs: DataFrame | None = None) -> DataFrame:
        every = features.select("doc_id", *keep).distinct() if docs is None else docs.select("doc_id", *keep)
        cells = vectorize.transform(features, self.vocabulary, **self.join)
        vectors = estimators.to_vectors(cells, self.size, docs=every)
        vectors = vectors.withColumnRenamed("features", "unscaled") if self.max_abs else vectors
        scored = self.model.transform(vectors)
        place = F.col("predicted_idx").cast("int")
        label = F.get(F.array(*[F.lit(c) for c in self.classes]), place)
        if "probability" in scored.columns:
            proba = vector_to_array("probability")
        else:  # all on the label
            proba = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda i: (i == place).cast("double"))
        return scored.select("doc_id", *keep, label.alias("predicted"), proba.alias("_p")).select(
            "doc_id", *keep, *_results(self.classes, F.col("_p"))
        )


@dataclass(frozen=True)
class Stages:
    """``pyspark.ml`` stages: those named ``clf`` last, the others before; a grid of their parameters."""

    pipes: Sequence[Pipe]

    def search(self, data: TrainingSet) -> Searched:
        pipes = [p.seeded(data.seed) for p in self.pipes]
        if data.max_abs:  # a stage like the others, fitted anew in every fold
            pipes = [Pipe("scaler", MaxAbsScaler(inputCol="unscaled", outputCol="features")), *pipes]
        grid = ParamGridBuilder()
        for p in pipes:
            for name, values in p.parameters.items():
                grid = grid.addGrid(estimators.find_param(p.stage, name), list(values))
        settings = grid.build()
        estimator = Pipeline(stages=[p.stage for p in pipes])
        if data.tf_idf:
            weighted = staged(vectorize.transform(
                data.weighted.where("fold IS NOT NULL AND label IS NOT NULL").withColumn("value", F.col("values")), data.vocabulary, **data.join
            ), "cells")

        def vectors_of(j: int) -> DataFrame:
            """Vectors as a model without fold ``j`` sees them, or the one of all rows."""
            cells = weighted.withColumn("value", F.get("value", F.lit(j))) if data.tf_idf else data.cells.drop("fold")
            found = estimators.to_vectors(cells, data.size, docs=data.train).withColumn("label_idx", index)
            return found.withColumnRenamed("features", "unscaled") if data.max_abs else found

        index = (F.array_position(F.array(*[F.lit(c) for c in data.labels]), F.col("label")) - 1).cast("double")
        vectors = vectors_of(data.folds)
        names = F.array(*[F.lit(c) for c in data.labels])
        label = F.get(names, F.col("predicted_idx").cast("int")).alias("predicted")
        parts = []
        for j in range(data.folds):
            seen = vectors_of(j) if data.tf_idf else vectors
            for i, model in estimator.fitMultiple(seen.where(F.col("fold") != j), settings):
                found = model.transform(seen.where(F.col("fold") == j))
                parts.append(found.select("doc_id", "label", "fold", F.lit(i).alias("setting"), label))
        oof = reduce(lambda a, b: a.unionByName(b), parts)

        def chosen(i: int) -> Model:
            model = estimator.fit(vectors, settings[i])
            return data.fitted(StageClassifier(model, data.labels, data.vocabulary, data.size, data.max_abs, data.join))

        said = [", ".join(f"{p.name}={v}" for p, v in s.items()) for s in settings]
        return Searched(estimators.name_of(pipes[-1].stage), said, oof, chosen)


@dataclass(frozen=True)
class Contest:
    """``grid(classifier, setting, name, parameters, mean_score, std_score, rank)``, the winner, its predictions and model."""

    grid: DataFrame
    name: str
    oof: DataFrame
    model: Model


def compete(data: TrainingSet, classifiers: Sequence[Classifier], average: str = "weighted") -> Contest:
    """Every setting of every classifier by its mean score over the folds; the later one wins on equal scores."""
    found = [c.search(data) for c in classifiers]
    table, oof = [], []
    for i, s in enumerate(found):
        oof.append(staged(s.oof, "oof"))
        scores = metrics.averaged_f1(oof[-1], average, ["setting", "fold"]).groupBy("setting")
        for r in scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).collect():
            table.append((i, r["setting"], s.name, s.settings[r["setting"]], r["mean"], r["std"]))
    order = sorted(table, key=lambda r: (round(r[4] or 0.0, 9), r[0], r[1]))
    best = order[-1]
    ahead = lambda r: sum(round(o[4] or 0.0, 9) > round(r[4] or 0.0, 9) for o in table)
    rows = [(*r, 1 + ahead(r)) for r in table]
    schema = "classifier int, setting int, name string, parameters string, mean_score double, std_score double, rank int"
    grid = data.docs.sparkSession.createDataFrame(sorted(rows), schema)
    mine = oof[best[0]].where(F.col("setting") == best[1]).drop("setting")
    said = f"{best[2]}({best[3]})"
    return Contest(grid, said, mine, found[best[0]].model(best[1]))
