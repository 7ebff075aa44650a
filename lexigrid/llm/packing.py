"""Best-fit packing of documents into bins, with conflicts.

A document of more than ``capacity`` characters is cut into full pieces and a
rest.  Pieces are dealt by a hash of the id to groups of about ``group_rows``,
or, given an order of the ids, number ``group_rows`` by ``group_rows`` in that
order, so that bins follow it.  Each group is packed by itself, longest piece
first.  Its open bins are
kept in order of residual room; a bin carries one bitmap of the sources and one
of the duplicate clusters in it.  The search starts at the tightest bin with
enough room and goes on to its successors until one has neither the source nor
the cluster of the piece; if none has, a new bin is opened.  So no bin holds
two pieces of one source or of one cluster, and every piece goes to the
tightest bin that may take it.

Nothing is collected: a group is a bounded number of short rows in a task.  A
source with a third of all rows spreads over the groups like any other.

Defined results: null or empty text is one piece of length 0; a null source or
cluster conflicts with nothing; equal lengths go by id, then piece; repeated
rows are packed each for itself; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm.tables import BROADCAST_ROWS
from lexigrid.operators.ranking import running_sum
from lexigrid.session import staged

_BIN_BITS = 32


def best_fit(
    lengths: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int
) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order."""
    bits: dict[object, int] = {}

    def bit(kind: str, value: object) -> int:
        return 0 if value is None else 1 << bits.setdefault((kind, value), len(bits))

    rooms: list[tuple[int, int]] = []  # (residual, bin) of open bins, sorted
    sources_in: list[int] = []
    clusters_in: list[int] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = bit("source", source), bit("cluster", cluster)
        for at in range(bisect_left(rooms, (length, -1)), len(rooms)):
            room, b = rooms[at]
            if not (sources_in[b] & s or clusters_in[b] & c):
                del rooms[at]
                break
        else:
            room, b = capacity, len(sources_in)
            sources_in.append(0)
            clusters_in.append(0)
        sources_in[b] |= s
        clusters_in[b] |= c
        insort(rooms, (room - length, b))
        bins.append(b)
        offsets.append(capacity - room)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int, texts: bool = False) -> DataFrame:
    """``doc_id, source, cluster, piece, start, length`` of ``docs(doc_id, text, source, cluster)``, and ``text``."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n - 1), F.lit(capacity).cast("long"))
    kept = ["doc_id", "source", "cluster", *(["text"] if texts else [])]
    cut = docs.select(*kept, n.alias("_n"), F.posexplode(starts).alias("piece", "start"))
    cut = cut.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("start"))).drop("_n")
    if texts:
        cut = cut.withColumn("text", F.expr("substring(coalesce(text, ''), cast(start + 1 as int), cast(length as int))"))
    return cut


def _in_order(docs: DataFrame, cut: DataFrame, order: DataFrame, capacity: int, group_rows: int) -> DataFrame:
    """``cut`` with its group: windows of ``group_rows`` pieces in order of ``order(doc_id, position)``.

    An id stands at its first position.  If it is repeated, its pieces are
    spread over the places of all of them by their content.
    """
    first = order.groupBy(F.col("doc_id").alias("_id")).agg(F.min("position").alias("_position"))
    sizes = pieces(docs, capacity).groupBy("doc_id").agg(
        F.count("*").alias("_pieces"), F.count(F.when(F.col("piece") == 0, 1)).alias("_rows")
    )
    sizes = sizes.join(first, sizes["doc_id"].eqNullSafe(F.col("_id"))).drop("doc_id")
    places = staged(running_sum(sizes, ["_position", "_id"], "_pieces", "_before"), "places")
    small = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    places = F.broadcast(places) if small else places.hint("shuffle_hash")
    spread = F.pmod(F.xxhash64("source", "cluster", "piece", "length"), F.col("_pieces"))
    number = F.col("_before") + F.when(F.col("_rows") == 1, F.col("piece")).otherwise(spread)
    placed = cut.join(places, cut["doc_id"].eqNullSafe(F.col("_id")))
    return placed.withColumn("_group", F.floor(number / group_rows)).select(*cut.columns, "_group")


def pack(
    docs: DataFrame, capacity: int = 16_384, group_rows: int = 2048, texts: bool = False, order: DataFrame | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, bin, offset`` for every piece of ``docs``;
    with ``texts`` also ``source`` and the ``text`` of the piece.

    With ``order(doc_id, position)``, which has every id, bins are numbered in
    that order, by windows of ``group_rows`` pieces.
    """
    cut = pieces(docs, capacity, texts)
    more = ["source", "text"] if texts else []

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            ["length", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True]
        )
        sources = [None if pd.isna(x) else x for x in rows["source"]]
        clusters = [None if pd.isna(x) else x for x in rows["cluster"]]
        bins, offsets = best_fit(rows["length"].tolist(), sources, clusters, capacity)
        out = rows[["doc_id", "piece", "start", "length", *more]].copy()
        out["bin"] = [(int(g) << _BIN_BITS) + b for g, b in zip(rows["_group"], bins, strict=True)]
        out["offset"] = offsets
        return out

    if order is None:
        groups = -(-pieces(docs, capacity).count() // group_rows)
        # the piece takes part, so that a very long text is spread as well
        cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, groups))))
    else:
        cut = _in_order(docs, cut, order, capacity, group_rows)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields = ["doc_id", "piece", "start", "length", *more, "bin", "offset"]
    kinds |= {"piece": "int", "start": "long", "length": "long", "bin": "long", "offset": "long"}
    schema = ", ".join(f"`{f}` {kinds[f]}" for f in fields)
    return cut.groupBy("_group").applyInPandas(packed, schema)
