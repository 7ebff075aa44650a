"""Exact stratified splits and folds.

Rows of a label are ordered by the MD5 of seed and document id.  The order is
the same on every cluster and in every engine, and close to random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DIGITS = 3


def hash_key(seed: int, id: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))


def label_ranks(rows: DataFrame, seed: int = 42, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``doc_id, label, rank, n_label``: 0-based place within the label.

    A label may hold most rows, so it is never sorted as a whole.  The first
    hex digits of the hash cut it into even buckets; places within a bucket
    are shifted by the size of the buckets before it.  One shuffle of ids.
    """
    keyed = rows.select("doc_id", "label", hash_key(seed).alias("_h")).withColumn(
        "_b", F.substring("_h", 1, digits)
    )
    label = Window.partitionBy("label")
    earlier = label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("label", "_b").agg(F.count("*").alias("_n"))
    bases = sizes.select(
        F.col("label").alias("_label"),
        F.col("_b").alias("_bucket"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(label).alias("n_label"),
    )
    inside = Window.partitionBy("label", "_b").orderBy("_h", "doc_id")
    ranked = keyed.withColumn("_row", F.row_number().over(inside) - 1)
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket"))
    return ranked.join(bases, same).select(
        "doc_id", "label", (F.col("_row") + F.col("_base")).alias("rank"), "n_label"
    )


def label_quotas(sizes: DataFrame, total: Column) -> DataFrame:
    """``label, quota``: share ``total`` among labels by largest remainder.

    ``sizes`` has one row ``label, n_label`` for each label; the window runs
    over these only.  Equal remainders go to the label that sorts first.
    """
    everything = Window.partitionBy()
    scaled = sizes.withColumn("_all", F.sum("n_label").over(everything)).withColumn("_want", total)
    share = "cast(_want AS decimal(38, 0)) * n_label"  # may exceed a bigint
    parts = scaled.withColumn("_whole", F.expr(f"{share} div _all")).withColumn(
        "_rest", F.expr(f"({share} % _all)")
    )
    left = F.col("_want") - F.sum("_whole").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("_rest"), "label"))
    return parts.select(
        "label", (F.col("_whole") + F.when(place <= left, 1).otherwise(0)).cast("bigint").alias("quota")
    )


def _quotas_for(ranks: DataFrame, total: Column) -> DataFrame:
    sizes = ranks.groupBy("label").agg(F.count("*").alias("n_label"))
    return label_quotas(sizes, total)


def stratified_split(rows: DataFrame, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """``doc_id, label, split, rank``: exactly ``ceil(test_size * N)`` test rows.

    ``rank`` is the place within label and split, so training subsets and
    folds can be cut from it without sorting again.
    """
    ranks = label_ranks(rows, seed)
    total = F.ceil(F.lit(float(test_size)) * F.col("_all"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n_label"))
    quotas = label_quotas(sizes, total).withColumnRenamed("label", "_label")
    held = F.col("rank") < F.col("quota")
    return ranks.join(quotas, F.col("label").eqNullSafe(F.col("_label"))).select(
        "doc_id",
        "label",
        F.when(held, "test").otherwise("train").alias("split"),
        F.when(held, F.col("rank")).otherwise(F.col("rank") - F.col("quota")).alias("rank"),
    )


def fold_of(rank: Column, k: int) -> Column:
    """Fold number of a row by its place within the label."""
    return (rank % k).cast("int")


def stratified_folds(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, label, fold``: fold sizes of a label differ by at most one."""
    return label_ranks(rows, seed).select("doc_id", "label", fold_of(F.col("rank"), k).alias("fold"))


def subset_quotas(train: DataFrame, part: int, parts: int) -> DataFrame:
    """``label, quota``: how many training rows of each label make up
    ``part / parts`` of all of them."""
    return _quotas_for(train, F.expr(f"{part} * _all div {parts}"))


def nested_subset(train: DataFrame, part: int, parts: int) -> DataFrame:
    """The first ``part / parts`` of the training rows, label shares kept.

    ``train`` comes from ``stratified_split``; smaller parts lie within larger.
    """
    quotas = F.broadcast(subset_quotas(train, part, parts).withColumnRenamed("label", "_label"))
    return (
        train.join(quotas, F.col("label").eqNullSafe(F.col("_label")))
        .where(F.col("rank") < F.col("quota"))
        .drop("_label", "quota")
    )
