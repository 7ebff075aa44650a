"""Grid search, the best classifier and learning curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.operators import metrics, naive_bayes, splits
from lexigrid.session import staged


def parameter_grid(stages: Mapping[str, Mapping[str, Sequence]]) -> list[dict]:
    """All combinations of ``<stage>__<parameter>`` values."""
    names = [f"{stage}__{p}" for stage, params in stages.items() for p in params]
    values = [v for params in stages.values() for v in params.values()]
    return [dict(zip(names, combo)) for combo in product(*values)]


def naive_bayes_grid(
    features: DataFrame,
    docs: DataFrame,
    alphas: Sequence[float],
    folds: int = 5,
    average: str = "weighted",
    train: Column | None = None,
    **join,
) -> DataFrame:
    """``alpha, fold, score`` for every smoothing value, from one scoring job."""
    preds = naive_bayes.out_of_fold(features, docs, folds, alphas, ["label"], train, **join)
    return metrics.averaged_f1(preds, average, ["alpha", "fold"])


def grid_report(scores: DataFrame, by: Sequence[str] = ("alpha",)) -> DataFrame:
    """Mean and spread over folds for each setting, with its rank.

    The window runs over one row for each setting of the grid.
    """
    means = scores.groupBy(*by).agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    rank = F.rank().over(Window.partitionBy().orderBy(F.desc(F.round("mean_score", 9))))
    return means.withColumn("rank", rank)


def best_model(scores: DataFrame, score: str = "mean_score", order: str = "ord") -> DataFrame:
    """The row with the best score, the later one on equal scores."""
    return scores.orderBy(F.desc(score), F.desc(order)).limit(1)


def learning_curve(
    features: DataFrame,
    split: DataFrame,
    parts: int,
    folds: int = 5,
    alphas: Sequence[float] = (1.0,),
    average: str = "weighted",
    max_abs: bool = False,
    **join,
) -> DataFrame:
    """``prop, alpha, train, test`` for training on ``parts - 1 .. 1`` of ``parts``.

    Every part is searched over the grid, scored out of fold on itself and,
    with the best value, on the test rows.  ``split`` comes from
    ``stratified_split``; ``features`` has its columns, so whether a row is in
    a part follows from its rank, without a join by document.  Vocabulary and
    size are those of all rows, as in the main run.

    The parts are nested, so sums by the first part a row is in give all of them:
    features are read twice, whatever the number of parts.
    """
    if parts < 2:
        raise ValueError("a curve needs two parts at least")
    train = split.where(F.col("split") == "train")
    # one row for each label
    quotas = reduce(
        lambda a, b: a.join(b, "label"),
        [splits.subset_quotas(train, p, parts).withColumnRenamed("quota", f"_q{p}") for p in range(1, parts)],
    )
    quotas = F.broadcast(staged(quotas.select("label", F.array(*[f"_q{p}" for p in range(1, parts)]).alias("_q")), "quotas"))
    first = F.size(F.filter("_q", lambda q: F.col("rank") >= q))
    part = F.when((F.col("split") == "train") & (first < parts - 1), first)

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.join(quotas, "label").withColumn("part", part).drop("_q")
        return rows.withColumn("fold", F.when(F.col("part").isNotNull(), splits.fold_of(F.col("rank"), folds)))

    rows, sides = marked(features), marked(split).withColumnRenamed("part", "first")
    asked = (F.col("split") == "test") | F.col("first").isNotNull()
    nested = naive_bayes.fit_parts(rows, sides.withColumnRenamed("first", "part"), parts - 1, folds=folds, max_abs=max_abs)
    preds = naive_bayes.score_parts(
        rows.withColumnRenamed("part", "first").where(asked), nested, ["label", "split", "first"], "fold", alphas,
        sides.where(asked), **join,
    ).where((F.col("split") == "test") | (F.col("first") <= F.col("part")))
    scores = metrics.averaged_f1(preds, average, ["part", "alpha", "split"])
    side = [F.max(F.when(F.col("split") == x, F.col("score"))).alias(x) for x in ("train", "test")]
    best = scores.groupBy("part", "alpha").agg(*side).groupBy("part").agg(F.max(F.struct("train", "alpha", "test")).alias("_b"))
    prop = (F.col("part") + 1) / F.lit(float(parts))
    return best.select(prop.alias("prop"), "_b.alpha", "_b.train", "_b.test").orderBy(F.desc("prop"))
