"""Vocabulary, label index, index features and weights.

The matrix stays in long form: one row for each non-zero cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexigrid.operators.lookup import lookup_join, parts_of
from lexigrid.operators.ranking import exact_rank
from lexigrid.session import staged


def fit_vocabulary(features: DataFrame) -> DataFrame:
    """``feature, idx``: distinct names numbered from 0 in code point order.

    Names are sorted in ranges of bounded bytes, as many as the names need.
    """
    names = staged(features.select("feature").distinct(), "names")
    return exact_rank(names, ["feature"], name="idx", parts=parts_of(names))


def transform(features: DataFrame, vocabulary: DataFrame, keep: Sequence[str] = (), **join) -> DataFrame:
    """``doc_id, *keep, idx, value``; unknown features are dropped."""
    found = lookup_join(features, vocabulary, ["feature"], **join)
    return found.select("doc_id", *keep, "idx", "value")


def fit_labels(rows: DataFrame) -> DataFrame:
    """``label, label_idx``: distinct labels numbered from 0 in sorted order."""
    labels = rows.where(F.col("label").isNotNull()).select("label").distinct()
    return exact_rank(labels, ["label"], name="label_idx")


def is_single_class(rows: DataFrame) -> bool:
    """True if there are fewer than two labels, so that nothing can be learnt."""
    return rows.select("label").where(F.col("label").isNotNull()).distinct().limit(2).count() < 2


def fit_transform(features: DataFrame, rows: DataFrame, **join) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Vocabulary, cells ``doc_id, idx, value``, and the rows with ``label_idx``.

    Rows of a single class have nothing to tell apart: they come without labels.
    """
    vocabulary = staged(fit_vocabulary(features), "vocabulary")
    cells = transform(features, vocabulary, **join)
    if is_single_class(rows):
        return vocabulary, cells, None
    return vocabulary, cells, encode_labels(rows.where(F.col("label").isNotNull()), staged(fit_labels(rows), "labels"), **join)


def encode_labels(rows: DataFrame, labels: DataFrame, **join) -> DataFrame:
    """Add ``label_idx``; a label that was not fitted is an error."""
    found = lookup_join(rows, labels, ["label"], "left", **join)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null"))))
    return found.withColumn("label_idx", F.coalesce("label_idx", unknown.cast("bigint")))


def decode_labels(rows: DataFrame, labels: DataFrame, **join) -> DataFrame:
    """Add ``label`` for ``label_idx``."""
    return lookup_join(rows, labels, ["label_idx"], **join)


def matrix_shape(features: DataFrame, docs: DataFrame, by: str = "split") -> DataFrame:
    """Rows and columns of the matrix of each split: ``split, n_rows, n_features``.

    Columns are those of the vocabulary, the same for every split.
    """
    width = features.select("feature").distinct().count()
    return docs.groupBy(by).agg(F.count("*").alias("n_rows"), F.lit(width).cast("bigint").alias("n_features"))


def fit_max_abs(features: DataFrame) -> DataFrame:
    """``feature, max_abs`` of the training rows."""
    return features.groupBy("feature").agg(F.max(F.abs("value")).alias("max_abs"))


def scale_max_abs(features: DataFrame, maxima: DataFrame, **join) -> DataFrame:
    """Divide by the fitted maximum; a maximum of 0 leaves 0."""
    found = lookup_join(features, maxima, ["feature"], **join)
    scaled = F.when(F.col("max_abs") == 0, 0.0).otherwise(F.col("value") / F.col("max_abs"))
    return found.withColumn("value", scaled).drop("max_abs").select(*features.columns)


def fit_idf(features: DataFrame, n_docs: int) -> DataFrame:
    """``feature, idf`` with ``ln((1 + N) / (1 + df)) + 1``."""
    df = F.count(F.when(F.col("value") != 0, 1))
    return features.groupBy("feature").agg((F.log(F.lit(1.0 + n_docs) / (1.0 + df)) + 1.0).alias("idf"))


def fit_idf_by_fold(features: DataFrame, docs: DataFrame, folds: int) -> DataFrame:
    """``feature, idf``: a list of weights, fitted without each fold and, last, on all rows that have one.

    Document frequencies are counted by fold in one pass; a fold is left out of
    their totals.  Rows without a fold only add to the vocabulary.
    """
    sizes = {r["fold"]: r["count"] for r in docs.where("fold IS NOT NULL").groupBy("fold").count().collect()}
    total = sum(sizes.values())
    seen = [F.count_if((F.col("fold") == j) & (F.col("value") != 0)).alias(f"_d{j}") for j in range(folds)]
    counted = features.groupBy("feature").agg(*seen)
    every = sum((F.col(f"_d{j}") for j in range(folds)), F.lit(0))
    weights = []
    for j in [*range(folds), None]:
        n = total - sizes.get(j, 0)
        df = every if j is None else every - F.col(f"_d{j}")
        weights.append(F.log(F.lit(1.0 + n) / (1.0 + df)) + 1.0)
    return counted.select("feature", F.array(*weights).alias("idf"))


def tf_idf_by_fold(features: DataFrame, idf: DataFrame, **join) -> tuple[DataFrame, DataFrame]:
    """Feature rows with ``values``, the weighted value by each entry of ``idf``; and ``doc_id, norm``, lengths likewise.

    Each weighting has length 1 for each document.  As in ``tf_idf``, only
    lengths are shuffled.
    """
    n = len(idf.first()["idf"]) if not idf.isEmpty() else 0
    found = lookup_join(features, idf, ["feature"], row_bytes=64 + 8 * n, **join)
    weighted = F.transform("idf", lambda w: w * F.col("value"))
    squares = [F.sum(F.pow(F.get("idf", F.lit(j)) * F.col("value"), 2)) for j in range(n)]
    lengths = found.groupBy("doc_id").agg(F.sqrt(squares[0]).alias("_0"), *[F.sqrt(x).alias(f"_{j + 1}") for j, x in enumerate(squares[1:])])
    lengths = staged(lengths.select("doc_id", F.array(*[f"_{j}" for j in range(n)]).alias("norm")), "lengths")
    scaled = lookup_join(found, lengths, ["doc_id"], row_bytes=32 + 8 * n)
    share = F.zip_with(weighted, "norm", lambda v, length: F.when(length == 0, 0.0).otherwise(v / length))
    return scaled.withColumn("values", share).select(*features.columns, "values"), lengths


def tf_idf(features: DataFrame, idf: DataFrame, **join) -> DataFrame:
    """Weighted values, scaled to length 1 for each document.

    Squares are added up where rows lie, so one number for each document and
    task is shuffled and the features themselves stay in place.
    """
    found = lookup_join(features, idf, ["feature"], **join)
    weighted = found.withColumn("value", F.col("value") * F.col("idf")).drop("idf")
    lengths = staged(weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_length")), "lengths")
    scaled = lookup_join(weighted, lengths, ["doc_id"], row_bytes=32)
    value = F.when(F.col("_length") == 0, 0.0).otherwise(F.col("value") / F.col("_length"))
    return scaled.withColumn("value", value).select(*features.columns)
