"""A whole experiment: split, features, grid, scores, record."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators import explain, metrics, naive_bayes, selection, splits, vectorize
from lexigrid.operators.annotate import Annotator
from lexigrid.operators.features import Extractor, Ngrams, extract_features
from lexigrid.operators.naive_bayes import MultinomialNB
from lexigrid.operators.placement import by_document
from lexigrid.operators.vectorize import scale_max_abs
from lexigrid.plans.serve import classify
from lexigrid.session import staged
from lexigrid.sources.readers import head_docs
from lexigrid.sources.registry import Registry, records


@dataclass(frozen=True)
class ExperimentConfig:
    """What to run.  ``tf_idf`` is for a ``Search``.  ``proportions`` asks for a learning curve in that many
    parts, ``lime_docs`` for explanations of the first documents."""

    name: str
    project: str = "-"
    extractors: Sequence[Extractor] = (Ngrams("char", (3,)),)
    cleaner: Callable[[Column], Column] | None = None
    annotator: Annotator | None = None
    max_abs: bool = False
    tf_idf: bool = False
    alphas: Sequence[float] = (1.0,)
    test_size: float = 0.3
    cv: int = 5
    average: str = "weighted"
    seed: int = 42
    proportions: int = 0
    lime_docs: int = 0
    lime_samples: int = 100
    train_source: Sequence[str] = ()
    test_source: Sequence[str] = ()
    lime_source: Sequence[str] = ()


@dataclass(frozen=True)
class FittedExperiment:
    """The results as tables, and the model on all training rows."""

    config: ExperimentConfig
    model: MultinomialNB
    maxima: DataFrame | None
    predictions: DataFrame
    grid: DataFrame
    scores: DataFrame
    report: DataFrame
    shapes: DataFrame
    curve: DataFrame | None
    explanations: DataFrame | None
    duration: float
    explained: DataFrame | None = None

    def classify(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``doc_id, *keep, proba, predicted, probability`` of new texts."""
        return classify(docs, self.model, scaled_extractors(self.config, self.maxima), self.config.cleaner, keep, self.config.annotator)

    def record(self) -> DataFrame:
        """The row of the overview table."""
        name = f"{type(self.model).__name__}(alpha={self.model.alpha})"
        row = record_of(self.config, name, self.scores, self.explanations, self.explained, self.duration)
        return records(self.predictions.sparkSession, [row])

    def log(self) -> DataFrame:
        """``step, key, value``: the run as an ordered report."""
        c = self.config
        head = self.predictions.sparkSession.createDataFrame(
            [("0 head", "name", c.name), ("0 head", "seed", str(c.seed))]
            + [("0 head", "features", str(e)) for e in c.extractors],
            "step string, key string, value string",
        )

        def rows(df: DataFrame, step: str, key: Column, *names: str) -> DataFrame:
            value = F.concat_ws(" ", *[F.format_string(f"{n}=%s", F.col(n).cast("string")) for n in names])
            return df.select(F.lit(step).alias("step"), key.alias("key"), value.alias("value"))

        parts = [
            rows(self.shapes, "1 sparse", F.col("split"), "n_rows", "n_features"),
            rows(self.grid, "2 grid", F.format_string("alpha=%s", F.col("alpha")), "rank", "mean_score", "std_score"),
            rows(self.report, "3 report", F.concat_ws(" ", "split", "label"), "precision", "recall", "f1", "support"),
            rows(self.scores, "4 score", F.col("split"), "score"),
        ]
        for p in parts:
            head = head.unionByName(p)
        return head.orderBy("step", "key")

    def save(self, registry: Registry) -> None:
        """Store record, model, predictions, scores and log under the name."""
        name = F.lit(self.config.name)
        registry.upsert("overview", self.record())
        registry.save_model(self.config.name, self.model, [str(e) for e in self.config.extractors])
        registry.upsert("predictions", self.predictions.withColumn("name", name))
        registry.upsert("scores", self.scores.withColumn("name", name))
        registry.upsert("log", self.log().withColumn("name", name))
        if self.maxima is not None:
            registry.upsert("maxima", self.maxima.withColumn("name", name))
        if self.curve is not None:
            registry.upsert("curve", self.curve.withColumn("name", name))


def record_of(
    c: ExperimentConfig, classifier: str, scores: DataFrame, explanations: DataFrame | None, explained: DataFrame | None, duration: float
) -> dict:
    """The fields of an experiment's record.

    Documents that were explained are named by their source; without one the
    texts themselves stand there.  Their number is a setting of the run.
    """
    test = scores.where("split = 'test'").first()
    found, texts = [], []
    if explanations is not None:
        chosen = explain.choose_explanation(explanations).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("k"), "word", "weight"))).alias("e")
        )
        order = explain.class_probabilities(explanations).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("place", "label", "probability"))).alias("p")
        )
        for r in chosen.join(order, "doc_id").orderBy("doc_id").collect():
            found.append(([(x["word"], x["weight"]) for x in r["e"]], [x["probability"] for x in r["p"]], [x["label"] for x in r["p"]]))
    if explained is not None:
        texts = [r["text"] for r in explained.orderBy("doc_id").collect()]
    return {
        "project": c.project,
        "name": c.name,
        "clf": classifier.split("(")[0],
        "clf_full": classifier,
        "features": ",".join(str(e) for e in c.extractors),
        "train_data": list(c.train_source) or ["-"],
        "train_data_path": list(c.train_source),
        "train_data_repr": list(c.train_source),
        "test_data": list(c.test_source) or ["split"],
        "test_data_path": list(c.test_source),
        "test_data_repr": list(c.test_source),
        "lime_data": list(c.lime_source) or texts or ["-"],
        "lime_data_path": list(c.lime_source),
        "lime_data_repr": texts,
        "lime_data_comp": found,
        "test_score": test["score"] if test else None,
        "dur": duration,
    }


def scaled_extractors(config: ExperimentConfig, maxima: DataFrame | None) -> list[Extractor]:
    """The extractors of a run, followed by its scaling."""
    if maxima is None:
        return list(config.extractors)

    def scaled(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return scale_max_abs(extract_features(docs, config.extractors, None, keep), maxima)

    return [scaled]


def split_and_fold(docs: DataFrame, c: ExperimentConfig, hold_out: bool = True) -> DataFrame:
    """``doc_id, label, split, rank, fold``; test rows have no fold."""
    rows = docs.select("doc_id", "label")
    if hold_out:
        sides = splits.stratified_split(rows, c.test_size, c.seed)
    else:
        ranks = splits.label_ranks(rows, c.seed)
        sides = ranks.select("doc_id", "label", F.lit("train").alias("split"), "rank")
    fold = F.when(F.col("split") == "train", splits.fold_of(F.col("rank"), c.cv))
    return staged(sides.withColumn("fold", fold), "sides")


def features_of(docs: DataFrame, sides: DataFrame, c: ExperimentConfig) -> DataFrame:
    """The feature rows of documents with the columns of ``sides``."""
    placed = by_document(docs.drop("label"), sides)
    keep = ["label", "split", "fold", "rank"]
    return staged(extract_features(placed, c.extractors, c.cleaner, keep, c.annotator), "features")


@dataclass
class Experiment:
    """Runs a configuration on documents ``doc_id, text, label``."""

    config: ExperimentConfig
    join: dict = field(default_factory=dict)

    def _features(self, docs: DataFrame, sides: DataFrame) -> DataFrame:
        return features_of(docs, sides, self.config)

    def run(self, docs: DataFrame, test_docs: DataFrame | None = None) -> FittedExperiment:
        """Hold out a stratified share, or test on ``test_docs`` if given.

        Held-out rows share the vocabulary of the data they were taken from;
        of an external test set only known features count.
        """
        started = time.monotonic()
        c = self.config
        is_train = F.col("split") == "train"
        if vectorize.is_single_class(docs):
            raise ValueError("there is nothing to learn from fewer than two labels")
        sides = split_and_fold(docs, c, hold_out=test_docs is None)
        twice = sides.groupBy("doc_id").count().where("count > 1").first()
        if twice:
            raise ValueError(f"several documents have the id {twice['doc_id']}")
        rows = self._features(docs, sides)
        maxima = None
        keep = ["label", "split", "fold"]
        # the scaler is part of the model, fitted anew without each fold
        preds, model = naive_bayes.cross_fit(rows, sides, c.cv, c.alphas, keep, is_train, max_abs=c.max_abs, **self.join)
        if c.max_abs:
            maxima = staged(model.maxima(), "maxima")
        model = model.merged()
        preds = staged(preds.select("doc_id", *keep, "alpha", "predicted"), "preds")
        grid = selection.grid_report(metrics.averaged_f1(preds.where(is_train), c.average, ["alpha", "fold"]))
        grid = staged(grid, "grid")
        best = selection.best_model(grid, order="alpha").first()["alpha"]
        final = preds.where(F.col("alpha") == best).drop("alpha")
        model = model.with_alpha(best)

        if test_docs is not None:
            outside = test_docs.select("doc_id", "label").select(
                "doc_id", "label", F.lit("test").alias("split"),
                F.lit(None).cast("int").alias("fold"), F.lit(None).cast("bigint").alias("rank"),
            )
            test_rows = self._features(test_docs, outside)
            if maxima is not None:
                test_rows = scale_max_abs(test_rows, maxima, **self.join)
            tested = naive_bayes.score(test_rows, model, keep, docs=outside, **self.join)
            final = final.unionByName(tested.select("doc_id", *keep, "predicted"))
            sides = sides.unionByName(outside.select(sides.columns))
        final = staged(final, "predictions")

        curve = None
        if c.proportions > 1 and test_docs is None:
            curve = staged(
                selection.learning_curve(
                    rows.drop("fold"), sides.drop("fold"), c.proportions, c.cv, c.alphas, c.average, c.max_abs, **self.join
                ),
                "curve",
            )
        width = F.lit(model.vocabulary_size).cast("bigint").alias("n_features")
        shapes = sides.groupBy("split").agg(F.count("*").alias("n_rows"), width)
        fitted = FittedExperiment(
            c, model, maxima, final, grid,
            metrics.averaged_f1(final, c.average, ["split"]),
            metrics.report_with_total(final, ["split"]),
            shapes, curve, None, round(time.monotonic() - started, 1),
        )
        if c.lime_docs:
            chosen = staged(head_docs(test_docs if test_docs is not None else docs, c.lime_docs).select("doc_id", "text"), "explained")
            found = staged(explain.explain(chosen, fitted.classify, c.lime_samples, seed=c.seed), "lime")
            fitted = replace(fitted, explanations=found, explained=chosen)
        return fitted


def load_experiment(registry: Registry, config: ExperimentConfig) -> Callable[[DataFrame], DataFrame]:
    """A stored model as a function from texts to label probabilities.

    ``config`` names the experiment and its extractors, as they are code.
    """
    model = registry.load_model(config.name)
    maxima = registry.component("maxima", config.name).drop("name") if config.max_abs else None
    extractors = scaled_extractors(config, maxima)
    return lambda docs: classify(docs, model, extractors, config.cleaner, annotator=config.annotator)
