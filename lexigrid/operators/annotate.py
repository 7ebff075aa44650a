"""Token annotations: arrays of ``(token, lemma, pos, sent)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lexigrid.operators.lookup import lookup_join
from lexigrid.operators.placement import by_document

PARSE = "array<struct<token:string,lemma:string,pos:string,sent:int>>"
PARSE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("token", T.StringType()),
            T.StructField("lemma", T.StringType()),
            T.StructField("pos", T.StringType()),
            T.StructField("sent", T.IntegerType()),
        ]
    )
)


RUN_BYTES = 1 << 18  # of text that a Python tagger works off at once


@dataclass(frozen=True)
class Annotator:
    """Fills in ``parse`` where it is missing; from raw or from cleaned text.

    ``fill`` is ``annotate`` or ``annotate_with`` with all but the documents given.
    """

    fill: Callable[[DataFrame], DataFrame]
    raw: bool = False


def parse_json(column: Column) -> Column:
    """Annotations from a JSON column."""
    return F.from_json(column, PARSE)


def parse_to_json(column: Column) -> Column:
    return F.to_json(column)


def tokens_by_position(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each space-separated token: ``doc_id, sent, at, token``.

    A sentence ends at a token that ends in ``. ! ?``.  Cutting at the space
    behind such a token first gives sentence numbers with no window.
    """
    sentences = docs.select(id, F.posexplode(F.split(text, "(?<=[.!?]) ")).alias("sent", "_s"))
    return sentences.select(id, "sent", F.posexplode(F.split("_s", " ")).alias("at", "token"))


def annotate(
    docs: DataFrame,
    lexicon: DataFrame,
    default_pos: str = "X()",
    id: str = "doc_id",
    text: str = "text",
    **join,
) -> DataFrame:
    """Fill in ``parse`` where it is missing by looking tokens up.

    ``lexicon`` has unique lower-case ``token`` with ``lemma`` and ``pos``.
    Unknown tokens are their own lemma and get ``default_pos``.  Texts are
    placed by document first, so tokens are gathered again without a shuffle.
    """
    placed = by_document(docs, id=id)
    missing = placed.where(F.col("parse").isNull()) if "parse" in docs.columns else placed
    words = tokens_by_position(missing, text, id).withColumn("_key", F.lower("token"))
    entries = lexicon.select(F.col("token").alias("_key"), "lemma", "pos")
    tagged = lookup_join(words, entries, ["_key"], "left", **join)
    item = F.struct(
        "sent",
        "at",
        "token",
        F.coalesce("lemma", "_key").alias("lemma"),
        F.coalesce("pos", F.lit(default_pos)).alias("pos"),
    )
    gathered = tagged.groupBy(id).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    found = gathered.select(
        id,
        F.transform(
            "_items", lambda x: F.struct(x["token"], x["lemma"], x["pos"], x["sent"])
        ).cast(PARSE).alias("_found"),
    )
    joined = placed.join(found, id, "left")
    parse = F.coalesce("parse", "_found") if "parse" in docs.columns else F.col("_found")
    return joined.withColumn("parse", parse).drop("_found")


def _text_runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``RUN_BYTES``; a longer text is a run of its own."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def annotate_with(docs: DataFrame, tagger: Callable[[str], list[tuple]], text: str = "text") -> DataFrame:
    """Annotations from any tagger ``text -> [(token, lemma, pos, sent), ...]``.

    The tagger runs inside tasks, over runs of documents of bounded bytes, so a
    worker holds the tokens of one run.  Rows that already have a parse keep it.
    """
    base = docs if "parse" in docs.columns else docs.withColumn("parse", F.lit(None).cast(PARSE))
    fields = [f for f in base.schema.fields if f.name != "parse"]
    schema = T.StructType([*fields, T.StructField("parse", PARSE_TYPE)])
    names = [f.name for f in schema.fields]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("token", "lemma", "pos", "sent")
        for batch in batches:
            for run in _text_runs(batch, text):
                given = run.column("parse")
                missing = given.is_null()
                texts = run.column(text).filter(missing).to_pylist()
                made = pa.array([[dict(zip(keys, item)) for item in tagger(t)] for t in texts], given.type)
                # a missing parse is taken from those made, which follow the given ones
                place = np.arange(run.num_rows)
                place[missing.to_numpy(zero_copy_only=False)] = run.num_rows + np.arange(len(texts))
                parses = pa.concat_arrays([given, made]).take(pa.array(place))
                columns = [parses if n == "parse" else run.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.select(*names).mapInArrow(tag, schema)
