"""N-gram counts over characters, words, tokens and tags.

The items of a document are padded with ``n`` empty items on both sides, so
``L`` items give ``L + n + 1`` grams.  A gram is named by its level and its
items joined by ``_``; equal names are counted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LEVELS = ("char", "text", "token", "pos")


def items_of(level: str, columns: Sequence[str]) -> Column:
    """The array of items that grams of a level are made of."""
    if level == "char":
        # splitting an empty text leaves one empty item, which is no character
        return F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ""))
    if level == "text":
        return F.split("text", " ")
    if level == "token":
        words = F.split("text", " ")
        if "parse" not in columns:
            return words
        return F.coalesce(F.transform("parse", lambda x: x["token"]), words)
    if level == "pos":
        if "parse" not in columns:
            raise ValueError("tag n-grams need a parse column")
        missing = F.raise_error(F.lit("tag n-grams need a parse for every document"))
        return F.coalesce(F.transform("parse", lambda x: x["pos"]), missing.cast("array<string>"))
    raise ValueError(f"unknown level {level!r}, use one of {LEVELS}")


def _gram_name(level: str, n: int, items: str, at: str) -> Column:
    parts: list[Column] = [F.lit(level + "-")]
    for k in range(n):
        if k:
            parts.append(F.lit("_"))
        parts.append(F.coalesce(F.get(items, F.col(at) + k), F.lit("")))
    return F.concat(*parts)


def gram_occurrences(
    docs: DataFrame,
    level: str = "token",
    n_list: Sequence[int] = (2,),
    id: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row ``doc_id, *keep, feature`` for each gram of each document.

    Start positions come from ``explode(sequence)`` and items are read by
    index, which stays in generated code.  Place documents first.
    """
    placed = docs.select(id, *keep, items_of(level, docs.columns).alias("_items"))
    grams = None
    for n in n_list:
        starts = F.sequence(F.lit(-n), F.size("_items"))
        rows = placed.select(id, *keep, "_items", F.explode(starts).alias("_at")).select(
            id, *keep, _gram_name(level, n, "_items", "_at").alias("feature")
        )
        grams = rows if grams is None else grams.unionByName(rows)
    return grams


def ngrams(
    docs: DataFrame,
    level: str = "token",
    n_list: Sequence[int] = (2,),
    id: str = "doc_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Counts ``doc_id, *keep, feature, value``; several n are added up."""
    rows = gram_occurrences(docs, level, n_list, id, keep)
    return rows.groupBy(id, *keep, "feature").agg(F.count("*").cast("double").alias("value"))
