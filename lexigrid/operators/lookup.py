"""Joins of large rows with a keyed table of unknown size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from lexigrid.session import staged

BROADCAST_BYTES = 128 << 20
HOT_SHARE = 1e-5
JOIN_BYTES = 32 << 20


def fits(table: DataFrame, rows: int) -> bool:
    """True if the table has no more than ``rows`` rows; reads no more either."""
    return rows > 0 and table.select(F.lit(1)).limit(rows + 1).count() <= rows


def _width(kind: DataType, value: Column) -> Column:
    """Bytes of a value as it lies in memory, near enough: lengths of strings, eight for each number."""
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, ArrayType):
        zero = F.lit(0).cast("long")
        return 16 + F.coalesce(F.aggregate(value, zero, lambda acc, x: acc + _width(kind.elementType, x)), zero)
    if isinstance(kind, StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind), F.lit(8))
    return F.lit(8)


def bytes_of(table: DataFrame) -> int:
    """Measured size of a table."""
    row = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in table.schema), F.lit(16))
    return table.agg(F.sum(row.cast("long"))).first()[0] or 0


def parts_of(*tables: DataFrame) -> int:
    """As many partitions as ``JOIN_BYTES`` of the tables go into, measured."""
    return max(1, -(-sum(map(bytes_of, tables)) // JOIN_BYTES))


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    row_bytes: int = 100,
    broadcast_bytes: int = BROADCAST_BYTES,
    table_bytes: int | None = None,
) -> DataFrame:
    """Join rows with a table whose keys are unique.

    A table of at most ``broadcast_bytes``, counted (by at least ``row_bytes`` a
    row) and then measured, is broadcast; ``table_bytes`` is its size if that has
    been measured before.  A larger one is joined by shuffle,
    except for hot keys: those that hold more than ``HOT_SHARE`` of the rows,
    as many of them as their part of the table may be broadcast.
    Their rows are joined where they lie instead of meeting in one task.  The
    others are dealt over partitions of about ``JOIN_BYTES``, measured, as a task
    sorts a whole partition in memory: the number of partitions grows with the
    input, not their size.  Rows with a null in the key find nothing and do not
    take part.
    """
    on = list(on)
    if table_bytes is None:
        small = fits(table, broadcast_bytes // row_bytes) and bytes_of(table) <= broadcast_bytes
    else:
        small = 0 < broadcast_bytes >= table_bytes
    if small:
        return facts.join(F.broadcast(table), on, how)
    no_key = reduce(or_, [F.col(k).isNull() for k in on])
    facts = staged(facts, "facts")
    keyed = facts.where(~no_key)
    sizes = staged(keyed.groupBy(*on).agg(F.count("*").alias("_n")), "sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.where(F.col("_n") > F.lit(max(1.0, total * HOT_SHARE))).select(*on)
    hot_table = staged(table.join(F.broadcast(hot), on, "left_semi"), "hot")
    size = bytes_of(hot_table)
    if size > broadcast_bytes:  # wide rows: keep the share of keys that fits, the same ones everywhere
        share = F.pmod(F.xxhash64(*on), F.lit(1000)) < int(1000 * 0.9 * broadcast_bytes / size)
        hot, hot_table = hot.where(share), hot_table.where(share)
    hot, hot_table = F.broadcast(hot), F.broadcast(hot_table)
    hot_rows = keyed.join(hot, on, "left_semi").join(hot_table, on, how)
    cold, parts = keyed.join(hot, on, "left_anti"), parts_of(keyed, table)
    cold_rows = cold.repartition(parts, *on).join(table.repartition(parts, *on), on, how)
    found = hot_rows.unionByName(cold_rows)
    if how != "left":
        return found
    kinds = {f.name: f.dataType for f in table.schema if f.name not in on}
    unmatched = facts.where(no_key).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    return found.unionByName(unmatched)
