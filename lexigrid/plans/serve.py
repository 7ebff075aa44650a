"""Classifying text with a fitted model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators import naive_bayes
from lexigrid.operators.annotate import Annotator
from lexigrid.operators.features import Extractor, extract_features
from lexigrid.operators.naive_bayes import MultinomialNB, softmax
from lexigrid.operators.placement import by_document


def vectorize(
    docs: DataFrame,
    extractors: Sequence[Extractor],
    cleaner: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = (),
    annotator: Annotator | None = None,
) -> DataFrame:
    """The feature rows of texts; may be stored and classified elsewhere."""
    return extract_features(by_document(docs), extractors, cleaner, keep, annotator)


def classify_features(
    features: DataFrame, model: MultinomialNB, keep: Sequence[str] = (), docs: DataFrame | None = None, **join
) -> DataFrame:
    """``doc_id, *keep, proba, predicted, probability`` from feature rows.

    ``docs`` lists the documents, so that those without a feature are not lost.
    """
    scored = naive_bayes.score(features, model, keep, docs=docs, **join)
    return scored.select("doc_id", *keep, *_results(model))


def _results(model: MultinomialNB) -> list[Column]:
    names = F.array(*[F.lit(c) for c in model.classes])
    proba = softmax(F.col("scores"))
    return [
        F.map_from_arrays(names, proba).alias("proba"),
        F.col("predicted"),
        F.array_max(proba).alias("probability"),
    ]


def classify(
    docs: DataFrame,
    model: MultinomialNB,
    extractors: Sequence[Extractor],
    cleaner: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = (),
    annotator: Annotator | None = None,
    **join,
) -> DataFrame:
    """Label probabilities of every text; the best one stands apart.

    A text without any known feature gets the class shares.
    """
    return classify_features(vectorize(docs, extractors, cleaner, keep, annotator), model, keep, docs, **join)


def best_only(classified: DataFrame) -> DataFrame:
    """``doc_id, predicted, probability``."""
    return classified.select("doc_id", "predicted", "probability")


def hard_labels(classified: DataFrame) -> DataFrame:
    """``doc_id, predicted``."""
    return classified.select("doc_id", "predicted")
