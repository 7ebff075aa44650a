"""Connected components of an edge table, by alternating star operations.

A large star links the larger neighbours of every node to its smallest one, a
small star the smaller ones (Kiveris et al., 2014).  Each round is two joins on
a node with its minimum, written as a table; the number of rounds grows with
the logarithm of the longest chain.  Nothing but two numbers a round reaches
the driver, and a node with very many neighbours is one that adaptive execution
may split, as its join is not a window over its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrid.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` of type long; the root is the smallest node reachable."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = edges.where("a <> b").select(big.alias("a"), small.alias("b")).distinct()
    now, mark = staged(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(rest.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum("b")).first()
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
