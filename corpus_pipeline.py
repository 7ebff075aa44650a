"""The training-data pipeline over ``documents``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the documents of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.llm import mixing, neardup, packing, pii, quality
from lexigrid.llm.tables import held_out, lookup, table
from lexigrid.session import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A deployment passes its own; this one makes the pipeline repeatable.
PII_KEY = b"corpus pipeline"
BIN_CHARS = 16_384
#: Pieces packed together: a window of the mixture.
WINDOW = 2048
#: Weights of the sources in the mixture; None: the square root of their sizes.
WEIGHTS: dict[str, float] | None = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out(0, 5)))
    return quality.score(docs, model, "_score").where("_score >= 0.3").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates, once."""
    docs = docs.select(*COLUMNS)
    found = staged(neardup.classes(docs), "classes")
    dropped = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    kept = lookup(docs, dropped, "doc_id", "left_anti").select(*COLUMNS)
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = staged(again, "repeated")
    if again.isEmpty():
        return kept
    once = lookup(kept, again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return lookup(kept, again, "doc_id", "left_anti").unionByName(once)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the new text."""
    docs = docs.select(*COLUMNS)
    return pii.surrogates(docs, PII_KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture of sources, weighted by ``WEIGHTS``."""
    docs = docs.select(*COLUMNS)
    return mixing.mixed(docs, WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of ``BIN_CHARS`` characters: the pieces of every document with bin and offset.

    Bins are filled from consecutive windows of the mixture and numbered in its
    order.  Stages hand on rows, not their order, so the mixture, which depends
    on ids and sizes of sources only, is worked out again.  Near-duplicates are
    gone by now, so a cluster is what is left equal after the replacement of
    personal data.
    """
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("cluster", F.xxhash64("text"))
    order = staged(mixing.mix(docs, WEIGHTS), "mixture")
    return packing.pack(docs, BIN_CHARS, WINDOW, texts=True, order=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_duplicates", one_of_each),
    ("private_data", surrogates),
    ("mixing", mixture),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
