"""Exact order numbers and running sums without a single sorting task.

``row_number()`` over one label, or over no partition at all, sorts the whole
group in one task.  Here rows are range partitioned on the sort key, numbered
where they lie, and shifted by the size of the ranges before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.session import staged

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _placed(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows in range partitions, with partition number and row within it."""
    at = F.col("_at")
    sorted_rows = df.repartitionByRange(*([] if parts is None else [parts]), *order).sortWithinPartitions(*order)
    table = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return (
        table.withColumn("_part", F.shiftright(at, _ROW_BITS))
        .withColumn("_row", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_at")
    )


def _before(group: Sequence[str], value: Column) -> Column:
    """Sum of a per-range value over the earlier ranges of the group.

    This window runs over one row for each range and group, never over data.
    """
    window = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def exact_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    name: str = "rank",
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its group.

    ``order`` should end in a unique column, so that positions are fixed and
    the ranges come out even.  ``parts`` is the number of ranges, the session's
    shuffle partitions if not given.
    """
    rows = _placed(df, [*_columns(group), *_columns(order)], parts)
    keys = [*group, "_part"]
    spans = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    shifts = spans.select(*keys, (_before(group, F.col("_n")) - F.col("_first")).alias("_shift"))
    return (
        _null_safe(rows, shifts, keys)
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def running_sum(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that sort before this one."""
    rows = _placed(df, _columns(order))
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_n"))
    bases = totals.select("_part", _before([], F.col("_n")).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(bases, "_part")
        .withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_row", "_base")
    )
