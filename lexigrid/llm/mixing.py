"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are shuffled by a keyed hash and cut into blocks of
``block_rows``.  Block i of a source with target share w is released at
``floor(i / w)`` and due at ``(i + 1) / w``; slot by slot the released block
with the earliest deadline goes next.  Shares are exact, as whole numbers of
any size, for the whole run: nothing is rounded to parts of a period.  So after
any slot every source is less than one block away from its share, whatever the
number of sources.

A source that runs out leaves its slots to the others in proportion to their
shares, and what each of them was ahead or behind is kept.  A source of weight
0 comes after all others have run out; several of them in equal shares.  If no
source has a weight, all shares are equal.  Nothing is dropped or repeated.

The order of blocks is one pass of a heap on the driver, a block in a few
microseconds; it holds one entry for each source and ``CHUNK`` slots, which are
staged as they come.  Rows never leave the executors: their ranks within their
source are exact over range partitions, so a source with a third of all rows is
spread like any other, and a row finds its slot by source and block.

Ties of deadlines go to the source that sorts first.  Null is a source of its
own; equal rows get different ranks; an empty table gives no rows.  Sources are
assumed to be thousands at most: their sizes are collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexigrid.operators.ranking import exact_rank
from lexigrid.session import new_path

CHUNK = 1 << 20  # slots that the driver holds at a time


def _weights(sizes: Mapping[str | None, int], weights: Mapping[str, float] | None) -> dict[str | None, float]:
    """Weight of each source, in order; without ``weights`` the square root of its rows."""
    order = sorted(sizes, key=lambda s: (s is not None, s or ""))
    found = {s: math.sqrt(sizes[s]) if weights is None else float(weights.get(s, 0.0)) for s in order}
    for s, w in found.items():
        if not 0 <= w < math.inf:
            raise ValueError(f"weight {w} of source {s!r}")
    return found


def slots(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[tuple[int, int]]:
    """For each slot ``(k, i)``: block i of source k, earliest deadline first.

    Time is counted in service: it has come to ``(D + 1) / W`` when the sources
    that are left, with weights of W together, have had D blocks.
    """
    exact = [Fraction(w) for w in weights]
    for positive in (True, False):
        alive = [k for k, n in enumerate(blocks) if n and (exact[k] > 0) == positive]
        scale = math.lcm(*(exact[k].denominator for k in alive))
        v = {k: int(exact[k] * scale) if positive else 1 for k in alive}
        total, given, done = sum(v.values()), 0, dict.fromkeys(alive, 0)
        bits = 2 * total.bit_length() + 1  # so that different fractions differ
        ready = [((1 << bits) // v[k], k) for k in alive]
        heapify(ready)
        waiting: list[tuple[int, int]] = []
        while ready or waiting:
            now = ((given + 1) << bits) // total
            while waiting and waiting[0][0] < now:
                k = heappop(waiting)[1]
                heappush(ready, (((done[k] + 1) << bits) // v[k], k))
            k = heappop(ready)[1]
            yield k, done[k]
            done[k] += 1
            given += 1
            if done[k] < blocks[k]:
                heappush(waiting, ((done[k] << bits) // v[k], k))
            else:
                given -= done[k]
                total -= v[k]


def _staged_slots(spark: SparkSession, found: Iterator[tuple[int, int]]) -> DataFrame:
    """``k, block, slot`` of ``(k, block)`` in order of slots."""
    path, first = new_path(spark, "schedule"), 0
    names = ["k", "block", "slot"]
    while True:
        part = list(islice(found, CHUNK))
        if part or not first:
            columns = [*(zip(*part, strict=True) if part else ((), ())), range(first, first + len(part))]
            rows = pa.table([pa.array(list(c), pa.int64()) for c in columns], names=names)
            spark.createDataFrame(rows).write.mode("append").parquet(path)
        first += len(part)
        if len(part) < CHUNK:
            return spark.read.schema("k long, block long, slot long").parquet(path)


def _earliest_deadline_first(counts: Column, slots: Column) -> Column:
    """For each slot ``(k, i)``: block i of source k; ``counts`` blocks of each source add up to ``slots``."""
    start = F.struct(
        F.transform(counts, lambda n: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<k:long,i:long>>").alias("out"),
    )

    def step(state: Column, t: Column) -> Column:
        done = state["done"]

        def job(n: Column, k: Column) -> Column:
            i = F.get(done, k)
            due = -F.floor(-((i + 1) * slots) / n)
            ready = (i < n) & (F.floor(i * slots / n) <= t)
            return F.when(ready, F.struct(due.cast("long").alias("due"), k.cast("long").alias("k"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(counts, job), lambda j: j.isNotNull()))
        taken = F.transform(
            F.array(best),
            lambda b: F.struct(
                F.transform(done, lambda d, k: d + (k == b["k"]).cast("long")).alias("done"),
                F.concat(state["out"], F.array(F.struct(b["k"].alias("k"), b["i"].alias("i")))).alias("out"),
            ),
        )
        return F.get(taken, F.lit(0))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, step, lambda s: s["out"])


def schedule(sources: DataFrame) -> DataFrame:
    """``source, first, i -> base, slots, slot``: the slot of block i of a source in
    the periods from ``first`` on, until the next ``first`` of the table.

    For shares that are whole parts ``c`` of a period; ``mix`` needs no periods."""
    one = F.sort_array(F.collect_list(F.struct("source", "c", "blocks")))
    row = sources.agg(one.alias("s")).where(F.size("s") > 0)
    last = F.transform("s", lambda s: F.floor(s["blocks"] / s["c"]))
    firsts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), last, F.transform(last, lambda m: m + 1))))
    kinds = row.select("s", F.explode(firsts).alias("first"))
    counts = F.transform("s", lambda s: F.greatest(F.lit(0).cast("long"), F.least(s["c"], s["blocks"] - s["c"] * F.col("first"))))
    zero = F.lit(0).cast("long")
    kinds = (
        kinds.withColumn("counts", counts)
        .withColumn("slots", F.aggregate("counts", zero, lambda a, n: a + n))
        .withColumn("base", F.aggregate("s", zero, lambda a, s: a + F.least(s["blocks"], s["c"] * F.col("first"))))
        .where("slots > 0")
    )
    plan = kinds.withColumn("plan", _earliest_deadline_first(F.col("counts"), F.col("slots")))
    return plan.select("s", "first", "slots", "base", F.posexplode("plan").alias("slot", "b")).select(
        F.get("s", F.col("b.k"))["source"].alias("source"), "first", F.col("b.i").alias("i"), "slots", "base",
        F.col("slot").cast("long").alias("slot"),
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    parts: int = 256,
    block_rows: int = 16,
    seed: int = 42,
) -> DataFrame:
    """``doc_id, source, share, block, slot, position`` for every row of ``docs(doc_id, source)``.

    Rows in order of ``position`` are the mixture; ``slot`` counts its blocks.
    ``parts``, once the length of a period, is taken but has no effect: shares are exact.
    """
    rows = docs.select("doc_id", "source").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    ranked = exact_rank(rows, ["_h", "doc_id"], ["source"], "rank")
    sizes = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    weight = _weights(sizes, weights)
    total = math.fsum(weight.values())
    shares = [(s, k, w / total if total else 1 / len(weight)) for k, (s, w) in enumerate(weight.items())]
    kinds = StructType([docs.schema["source"], StructField("k", LongType()), StructField("share", DoubleType())])
    about = docs.sparkSession.createDataFrame(shares, kinds)
    blocks = [-(-sizes[s] // block_rows) for s in weight]
    plan = _staged_slots(docs.sparkSession, slots(blocks, list(weight.values())))
    placed = (
        ranked.join(F.broadcast(about), ranked["source"].eqNullSafe(about["source"]))
        .select("doc_id", ranked["source"], "share", "rank", "k")
        .withColumn("block", F.expr(f"rank div {block_rows}"))
    )
    return placed.join(plan, ["k", "block"]).select(
        "doc_id", "source", "share", "block", "slot",
        (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """``docs`` in the order of the mixture, over range partitions.

    Rows that share an id, if there are any, go to the first place of that id.
    Columns ``_position`` and ``_id`` are not kept.
    """
    docs = docs.drop("_position", "_id")
    order = mix(docs, weights, **options).groupBy("doc_id").agg(F.min("position").alias("_position"))
    rows = docs.join(order.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")))
    return rows.repartitionByRange("_position").sortWithinPartitions("_position").select(*docs.columns)
