"""Experiments in which different classifiers compete.

Split, features, one search over all classifiers, scores on held-out or
external text, a learning curve, explanations and a record, whatever the
winner is: a fitted model is asked for nothing but ``classify``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from lexigrid.operators import explain, metrics, splits, vectorize
from lexigrid.operators.classifiers import Classifier, Model, TrainingSet, compete
from lexigrid.operators.features import extract_features
from lexigrid.operators.placement import by_document
from lexigrid.plans.experiment import ExperimentConfig, features_of, record_of, split_and_fold
from lexigrid.session import staged
from lexigrid.sources.readers import head_docs
from lexigrid.sources.registry import Registry, records


@dataclass(frozen=True)
class FittedSearch:
    """The winner on all training rows, and the results as tables."""

    config: ExperimentConfig
    classifier: str
    model: Model
    predictions: DataFrame
    grid: DataFrame
    scores: DataFrame
    report: DataFrame
    shapes: DataFrame
    curve: DataFrame | None
    explanations: DataFrame | None
    explained: DataFrame | None
    duration: float

    def classify(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``doc_id, *keep, proba, predicted, probability`` of new texts."""
        c = self.config
        rows = extract_features(by_document(docs), c.extractors, c.cleaner, keep, c.annotator)
        return self.model.classify(rows, keep, docs)

    def record(self) -> DataFrame:
        """The row of the overview table."""
        row = record_of(self.config, self.classifier, self.scores, self.explanations, self.explained, self.duration)
        return records(self.predictions.sparkSession, [row])

    def save(self, registry: Registry) -> None:
        """Store record, predictions, grid, scores and curve under the name."""
        name = F.lit(self.config.name)
        registry.upsert("overview", self.record())
        for table, rows in (("predictions", self.predictions), ("grid", self.grid), ("scores", self.scores), ("curve", self.curve)):
            if rows is not None:
                registry.upsert(table, rows.withColumn("name", name) if table != "grid" else rows.withColumnsRenamed({"name": "clf"}).withColumn("name", name))


@dataclass
class Search:
    """Runs a configuration with the classifiers given, the last one winning ties."""

    config: ExperimentConfig
    classifiers: Sequence[Classifier]
    join: dict = field(default_factory=dict)

    def _contest(self, features: DataFrame, sides: DataFrame):
        c = self.config
        return compete(TrainingSet(features, sides, c.cv, c.max_abs, c.seed, self.join, c.tf_idf), self.classifiers, c.average)

    def run(self, docs: DataFrame, test_docs: DataFrame | None = None, lime_docs: DataFrame | None = None) -> FittedSearch:
        """Hold out a stratified share, or test on ``test_docs`` if given; ``lime_docs`` or the first test texts are explained."""
        started = time.monotonic()
        c = self.config
        if vectorize.is_single_class(docs):
            raise ValueError("there is nothing to learn from fewer than two labels")
        sides = split_and_fold(docs, c, hold_out=test_docs is None)
        rows = features_of(docs, sides, c)
        won = self._contest(rows, sides)
        model, keep = won.model, ["label", "split", "fold"]

        if test_docs is None:
            asked, test_rows = sides.where("split = 'test'"), rows.where("split = 'test'")
        else:
            asked = test_docs.select(
                "doc_id", "label", F.lit("test").alias("split"), F.lit(None).cast("int").alias("fold"), F.lit(None).cast("bigint").alias("rank")
            )
            test_rows = features_of(test_docs, asked, c)
        columns = ["doc_id", *keep, "predicted"]
        out_of_fold = won.oof.withColumn("split", F.lit("train")).select(columns)
        preds = staged(out_of_fold.unionByName(model.classify(test_rows, keep, asked).select(columns)), "predictions")
        every = sides.select("doc_id", "split") if test_docs is None else sides.select("doc_id", "split").unionByName(asked.select("doc_id", "split"))
        width = F.lit(rows.select("feature").distinct().count()).cast("bigint").alias("n_features")
        fitted = FittedSearch(
            c, won.name, model, preds, won.grid,
            metrics.averaged_f1(preds, c.average, ["split"]),
            metrics.report_with_total(preds, ["split"]),
            every.groupBy("split").agg(F.count("*").alias("n_rows"), width),
            self._curve(rows, sides, test_rows, asked) if c.proportions > 1 else None,
            None, None, round(time.monotonic() - started, 1),
        )
        if c.lime_docs:
            pool = lime_docs if lime_docs is not None else test_docs if test_docs is not None else docs
            chosen = staged(head_docs(pool, c.lime_docs).select("doc_id", "text"), "explained")
            found = staged(explain.explain(chosen, fitted.classify, c.lime_samples, seed=c.seed), "lime")
            fitted = replace(fitted, explanations=found, explained=chosen)
        return fitted

    def _curve(self, rows: DataFrame, sides: DataFrame, test_rows: DataFrame, asked: DataFrame) -> DataFrame:
        """``prop, classifier, train, test``: the search again on nested parts of the training rows, same vocabulary."""
        c, points = self.config, []
        train = sides.where("split = 'train'")
        for part in range(c.proportions - 1, 0, -1):
            quotas = F.broadcast(splits.subset_quotas(train, part, c.proportions))  # a row for each label
            fold = F.when((F.col("split") == "train") & (F.col("rank") < F.col("quota")), splits.fold_of(F.col("rank"), c.cv))
            marked = [x.join(quotas, "label", "left").withColumn("fold", fold).drop("quota") for x in (rows, sides)]
            won = self._contest(staged(marked[0], "part"), staged(marked[1], "sides"))
            tested = won.model.classify(test_rows, ["label"], asked)
            score = [metrics.averaged_f1(x, c.average).select(F.col("score").alias(n)) for x, n in ((won.oof, "train"), (tested, "test"))]
            found = {n: s.first()[n] for n, s in zip(("train", "test"), score)}
            points.append((part / c.proportions, won.name, found["train"], found["test"]))
        return sides.sparkSession.createDataFrame(points, "prop double, classifier string, train double, test double")
