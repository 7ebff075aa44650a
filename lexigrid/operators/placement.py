"""Where documents lie before they are taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexigrid.operators.lookup import bytes_of

PART_BYTES = 4 << 20


def parts_for(docs: DataFrame, text: str = "text") -> int:
    """As many partitions as ``PART_BYTES`` of text go into; counted over all documents."""
    measured = docs.select(text) if text in docs.columns else docs
    return max(1, -(-bytes_of(measured) // PART_BYTES))


def by_document(docs: DataFrame, attributes: DataFrame | None = None, id: str = "doc_id") -> DataFrame:
    """Documents hash partitioned by id, with columns of ``attributes`` joined.

    Texts are moved once, before they are taken apart: whatever is grouped by
    document afterwards needs no shuffle, and a text is about a tenth of the
    size of its grams.  A task counts the tokens and grams of a whole partition
    in memory, so partitions are measured to hold about ``PART_BYTES`` of text
    each, and their number grows with the input, not their size.
    ``attributes`` (label, split, fold) come by id and are narrow; they are hashed
    in each partition, so texts are neither sorted nor broadcast.
    """
    placed = docs.repartition(parts_for(docs), id)
    return placed if attributes is None else placed.join(attributes.hint("shuffle_hash"), id)
