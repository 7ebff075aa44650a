"""Local explanations: which words carry a prediction.

Samples of a document with words left out are classified like any other text,
and a weighted linear fit gives every word a weight for every label.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.fixed_values import HIGHLIGHT


def _uniform(*parts: Column) -> Column:
    """A fixed number in [0, 1) from the MD5 of some values."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def drop_rate(seed: int, doc: Column, sample: Column) -> Column:
    """Share of words to leave out of a sample; sample 0 is the whole text."""
    return F.when(sample == 0, 0.0).otherwise(_uniform(F.lit(seed), doc, sample))


def keeps(seed: int, doc: Column, sample: Column, word: Column, rate: Column) -> Column:
    """True if the sample keeps the word, wherever it stands in the text."""
    return _uniform(F.lit(seed), doc, sample, word) >= rate


def perturb(docs: DataFrame, samples: int = 100, seed: int = 42) -> DataFrame:
    """``doc_id, sample, text, words, mask`` for each document and sample.

    ``mask`` says for each distinct word whether the sample keeps it.
    """
    tokens = docs.select("doc_id", F.split("text", " ").alias("_tokens"))
    spread = tokens.select(
        "doc_id",
        "_tokens",
        F.array_sort(F.array_distinct("_tokens")).alias("words"),
        F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"),
    ).withColumn("_rate", drop_rate(seed, F.col("doc_id"), F.col("sample")))

    def kept(w: Column) -> Column:
        return keeps(seed, F.col("doc_id"), F.col("sample"), w, F.col("_rate"))

    return spread.select(
        "doc_id",
        "sample",
        F.array_join(F.filter("_tokens", kept), " ").alias("text"),
        "words",
        F.transform("words", lambda w: kept(w).cast("double")).alias("mask"),
    )


def _ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, strength: float) -> np.ndarray:
    """Weighted ridge coefficients; the intercept is not penalised."""
    share = w / w.sum()
    xc = (x - share @ x) * np.sqrt(w)[:, None]
    yc = (y - share @ y) * np.sqrt(w)[:, None]
    if x.shape[1] <= x.shape[0]:
        return np.linalg.solve(xc.T @ xc + strength * np.eye(x.shape[1]), xc.T @ yc)
    # more words than samples: the same weights from a system of one row for each sample
    return xc.T @ np.linalg.solve(xc @ xc.T + strength * np.eye(x.shape[0]), yc)


def local_weights(
    mask: np.ndarray, proba: np.ndarray, top: int, kernel_width: float, strength: float
) -> list[list[tuple[int, float]]]:
    """For each label, the ``top`` words by weight with their weights."""
    distance = 100.0 * (1.0 - np.sqrt(mask.mean(axis=1)))
    weight = np.exp(-(distance**2) / kernel_width**2) ** 0.5
    first = _ridge(mask, proba, weight, strength)
    out = []
    for c in range(proba.shape[1]):
        chosen = np.sort(np.argsort(-np.abs(first[:, c]), kind="stable")[:top])
        coef = _ridge(mask[:, chosen], proba[:, [c]], weight, strength)[:, 0]
        out.append([(int(i), float(v)) for i, v in zip(chosen, coef)])
    return out


def explain(
    docs: DataFrame,
    classify: Callable[[DataFrame], DataFrame],
    samples: int = 100,
    top: int = 10,
    kernel_width: float = 25.0,
    strength: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """``doc_id, label, probability, word, weight`` for chosen documents.

    ``classify`` maps ``doc_id, text`` to ``doc_id, proba MAP``.  A group of
    the fit holds the samples of one document, whose number is a parameter.
    """
    drawn = perturb(docs, samples, seed).withColumn(
        "_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sample").cast("string"))
    )
    scored = classify(drawn.select(F.col("_id").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("_id"), "proba"
    )
    labels_first = F.array_sort(F.map_keys("proba"))
    rows = drawn.drop("text").join(scored, "_id").select(
        "doc_id", "sample", "words", "mask",
        labels_first.alias("labels"),
        F.transform(labels_first, lambda c: F.element_at("proba", c)).alias("p"),
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sample")
        words, labels = list(group["words"].iloc[0]), list(group["labels"].iloc[0])
        mask, proba = np.stack(group["mask"].to_list()), np.stack(group["p"].to_list())
        found = local_weights(mask, proba, top, kernel_width, strength)
        return pd.DataFrame(
            [
                (group["doc_id"].iloc[0], label, proba[0, c], words[i], v)
                for c, label in enumerate(labels)
                for i, v in found[c]
            ],
            columns=["doc_id", "label", "probability", "word", "weight"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("doc_id").applyInPandas(
        fit, f"doc_id {kind}, label string, probability double, word string, weight double"
    )


def choose_explanation(explained: DataFrame) -> DataFrame:
    """Weights of each document's most probable label; on ties the later name."""
    first = Window.partitionBy("doc_id").orderBy(F.desc("probability"), F.desc("label"))
    return explained.withColumn("_r", F.dense_rank().over(first)).where("_r = 1").drop("_r")


def class_probabilities(explained: DataFrame) -> DataFrame:
    """``doc_id, place, label, probability`` with the most probable label first."""
    first = Window.partitionBy("doc_id").orderBy(F.desc("probability"), F.desc("label"))
    rows = explained.select("doc_id", "label", "probability").distinct()
    return rows.withColumn("place", F.row_number().over(first))


def weight_series(explained: DataFrame) -> DataFrame:
    """``doc_id, label, word, weight, sign``: the numbers behind the bars."""
    sign = F.when(F.col("weight") < 0, "-").otherwise("+")
    return explained.select("doc_id", "label", "word", "weight", sign.alias("sign"))


def highlight(text: Column, words: Column, colors: Sequence[str] = ("green", "red")) -> Column:
    """Wrap explained words in a coloured tag, by the sign of their weight.

    ``words`` is an array of ``(word, weight)``.  Double quotes are dropped
    and the text is cut at single spaces.
    """
    plus, minus = colors
    weights = F.map_from_entries(words)

    def tag(w: Column) -> Column:
        weight = F.try_element_at(weights, w)
        color = F.when(weight < 0, minus).otherwise(plus)
        head, rest = HIGHLIGHT.split("{0}")
        middle, tail = rest.split("{1}")
        wrapped = F.concat(F.lit(head), color, F.lit(middle), w, F.lit(tail))
        return F.when(weight.isNull(), w).otherwise(wrapped)

    return F.array_join(F.transform(F.split(F.replace(text, F.lit('"'), F.lit("")), " "), tag), " ")
