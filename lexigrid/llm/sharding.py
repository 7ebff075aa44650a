"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Documents are put in order of id over range partitions.  Each partition adds up
its bytes and rows; the totals, one row for each partition, give every
partition the bytes and rows before it, and a running sum inside it does the
rest.  The total is cut at equal targets: a document goes to the shard that its
middle byte falls in, so a shard misses its target by half a document at
either end at most.  Only ids and sizes move; texts are read where they lie.

Size is the UTF-8 length of the text, 0 for null, plus 1.  Rows with equal ids
are ordered by checksum and size; null ids come first.  An empty table gives no
rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexigrid.session import staged

_ROW_BITS = 33


def shard(docs: DataFrame, shards: int, order: tuple[str, ...] = ("doc_id",), size: str = "size") -> DataFrame:
    """Add ``shard`` and ``slot``, the place in the shard from 0.

    ``docs`` should be narrow, as all its columns move; ``order`` and ``size``
    name columns of it.  Columns named as results or working columns are replaced.
    """
    docs = docs.drop("shard", "slot", "_at", "_part", "_rank", "_middle", "_all", "_first")
    keys = [F.col(c).asc_nulls_first() for c in order]
    at = F.monotonically_increasing_id()
    placed = docs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    placed = staged(placed, "ranges").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    # one row for each range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(every).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy("_at")
    rows = placed.join(F.broadcast(bases), "_part").select(
        *docs.columns,
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_rank"),
        (2 * (F.col("_bytes_before") + F.sum(size).over(inside)) - F.col(size)).alias("_middle"),
        "_all",
    )
    rows = rows.withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div (2 * _all)")).cast("int")
    )
    firsts = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (
        rows.join(F.broadcast(firsts), "shard")
        .withColumn("slot", F.col("_rank") - F.col("_first"))
        .select(*docs.columns, "shard", "slot")
    )
