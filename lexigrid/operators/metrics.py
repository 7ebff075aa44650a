"""Scores of predictions.

Everything but the area under the curve follows from counts by true and
predicted label, so predictions are read once and shrink to a few rows before
the shuffle.  ``by`` names columns that tell runs apart: split, fold, alpha.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.operators.ranking import running_sum


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where there is nothing to divide by."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def label_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, label, predicted, n`` for the pairs that occur."""
    return preds.groupBy(*by, "label", "predicted").agg(F.count("*").alias("n"))


def confusion(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by true and predicted label, zeros filled in.

    The grid of labels is the result itself; it is spread from one array of
    the labels that occur.
    """
    counts = label_counts(preds, by)
    labels = F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("predicted")))
    grid = (
        counts.groupBy(*by).agg(labels.alias("_labels"))
        .select(*by, "_labels", F.explode("_labels").alias("label"))
        .select(*by, "label", F.explode("_labels").alias("predicted"))
    )
    return grid.join(counts, [*by, "label", "predicted"], "left").fillna(0, ["n"])


def confusion_matrix(preds: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row for each true label, one column for each predicted label."""
    return preds.groupBy("label").pivot("predicted", list(labels)).count().fillna(0)


def class_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, label, precision, recall, f1, support`` for every label."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("_l"), hit.alias("tp"), F.col("n").alias("support"), none.alias("given")),
        F.struct(F.col("predicted").alias("_l"), none.alias("tp"), none.alias("support"), F.col("n").alias("given")),
    )
    sums = (
        label_counts(preds, by).select(*by, F.inline(sides))
        .groupBy(*by, F.col("_l").alias("label"))
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given"))
    )
    return sums.select(
        *by,
        "label",
        _ratio(F.col("tp"), F.col("given")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("given")).alias("f1"),
        "support",
        "tp",
        "given",
    )


def f1_averages(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, f1_binary, f1_micro, f1_macro, f1_weighted, accuracy``.

    Binary is the score of the second label in sorted order.
    """
    report = class_report(preds, by)
    ordered = F.array_sort(F.collect_list(F.struct("label", "f1")))
    sums = report.groupBy(*by).agg(
        ordered.alias("_f"),
        F.sum("tp").alias("_tp"),
        F.sum("given").alias("_given"),
        F.sum("support").alias("_n"),
        F.avg("f1").alias("f1_macro"),
        F.sum(F.col("f1") * F.col("support")).alias("_w"),
    )
    return sums.select(
        *by,
        F.when(F.size("_f") == 2, F.get("_f", F.lit(1))["f1"]).alias("f1_binary"),
        _ratio(2 * F.col("_tp"), F.col("_n") + F.col("_given")).alias("f1_micro"),
        "f1_macro",
        _ratio(F.col("_w"), F.col("_n")).alias("f1_weighted"),
        _ratio(F.col("_tp"), F.col("_n")).alias("accuracy"),
    )


def averaged_f1(preds: DataFrame, average: str, by: Sequence[str] = ()) -> DataFrame:
    """``*by, score`` with one of the averages binary, micro, macro, weighted."""
    if average not in ("binary", "micro", "macro", "weighted"):
        raise ValueError(f"unknown average {average!r}")
    return f1_averages(preds, by).select(*by, F.col(f"f1_{average}").alias("score"))


def report_with_total(preds: DataFrame, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """The report with a last row of means weighted by support."""
    report = class_report(preds, by)
    names = ("precision", "recall", "f1")

    def mean(c: str) -> Column:
        return F.round(_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), digits).alias(c)

    total = report.groupBy(*by).agg(*[mean(c) for c in names], F.sum("support").alias("support"))
    rows = report.select(*by, "label", *[F.round(c, digits).alias(c) for c in names], "support")
    return rows.unionByName(total.withColumn("label", F.lit("avg / total")))


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, accuracy``: share of equal labels."""
    hit = F.when(F.col("label") == F.col("predicted"), 1.0).otherwise(0.0)
    return preds.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def roc_auc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """``auc``: chance that a positive row scores above a negative one.

    Rows are first counted by score.  Each score then needs the number of
    negatives below it, a running sum over ranges of scores.  Null unless both
    classes occur.
    """
    counts = scored.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(positive, 0).otherwise(1)).alias("_q"),
    )
    below = running_sum(counts, ["_s"], "_q", "_below")
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2.0))
    pairs = F.sum("_p").cast("double") * F.sum("_q")
    return below.agg(wins.alias("_w"), pairs.alias("_pairs")).select(
        F.when(F.col("_pairs") > 0, F.col("_w") / F.col("_pairs")).alias("auc")
    )


def label_distribution(rows: DataFrame) -> DataFrame:
    """``label, n, share, baseline``; the baseline always guesses the largest.

    The window runs over one row for each label.
    """
    everything = Window.partitionBy()
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(everything)
    return counts.withColumn("share", share).withColumn("baseline", F.max("share").over(everything))


def score_series(curve: DataFrame, final: DataFrame) -> DataFrame:
    """``prop, train, test`` in order, the scores on all data at 1.0.

    Missing scores are 0.
    """
    rows = curve.select("prop", "train", "test").unionByName(
        final.select(F.lit(1.0).alias("prop"), "train", "test")
    )
    return rows.fillna(0.0, ["train", "test"]).orderBy("prop")
