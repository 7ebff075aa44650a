"""The tables that the dealt queries read, and columns shared by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(remainder: int, modulus: int, id: str = "doc_id") -> Column:
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: Rows of a few bytes each that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def lookup(rows: DataFrame, narrow: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join wide ``rows`` with a narrow table of unique keys.

    The table is counted first: below ``BROADCAST_ROWS`` it is broadcast and
    the rows stay where they are, beyond it both sides are shuffled and the
    narrow one is hashed, so that texts are not sorted.
    """
    small = narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(narrow) if small else narrow.hint("shuffle_hash"), on, how)
