"""Multinomial naive Bayes as joins and sums.

Training keeps sums by feature and class.  With smoothing ``a``, class sums
``s`` and ``V`` features, up to a constant for each document

    log P(c | d) = log P(c) - T log((s_c + aV) / a) + sum_f v log(s_fc / a + 1)

where ``v`` are the document's values and ``T`` is their sum over known
features.  A class that lacks a feature adds nothing, so there is no grid of
features and classes; and cross validation takes the sums of a fold off the
totals instead of training again.  There is one form for any number of classes
and folds: features are read once to train and once to score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators.lookup import lookup_join
from lexigrid.session import staged

_COLUMNS = 64


@dataclass(frozen=True)
class MultinomialNB:
    """Sums of the training rows, by feature in a table and by class in lists.

    ``docs`` and ``totals`` have a list by class for every fold; without folds
    there is a single one.  ``sums`` has a row for each known feature; its
    ``cells`` are the classes it occurs in, each with its sum in every fold.

    With max-abs scaling, ``sums`` also has ``scale``: the largest value outside
    each fold and, last, of all.  A scaled sum is the raw one divided by it, so
    the scaler is refitted for every fold without another pass; ``scaled`` has
    the class sums that go with it.
    """

    classes: tuple[str, ...]
    docs: tuple[tuple[int, ...], ...]
    totals: tuple[tuple[float, ...], ...]
    vocabulary_size: int
    sums: DataFrame
    alpha: float = 1.0
    scaled: tuple[tuple[float, ...], ...] = ()
    ready: NestedNB | None = field(default=None, compare=False, repr=False)

    @property
    def folds(self) -> int:
        return len(self.docs)

    def with_alpha(self, alpha: float) -> "MultinomialNB":
        return replace(self, alpha=alpha)

    def merged(self) -> "MultinomialNB":
        """The same model without folds."""
        if self.folds == 1 and not self.scaled:
            return self
        by = _divisor(F.get("scale", F.lit(self.folds))) if self.scaled else F.lit(1.0)
        cells = F.transform("cells", lambda x: F.struct(x["c"].alias("c"), F.array(_total(x["s"]) / by).alias("s")))
        return replace(
            self,
            docs=(tuple(self._without(self.docs, None)),),
            totals=(tuple(self._masses(None)),),
            sums=self.sums.select("feature", cells.alias("cells")),
            scaled=(),
            ready=None,
        )

    def maxima(self) -> DataFrame:
        """``feature, max_abs`` over all training rows, of a scaled model."""
        return self.sums.select("feature", F.get("scale", F.lit(self.folds)).alias("max_abs"))

    def _masses(self, fold: int | None) -> list[float]:
        """Sums of values by class outside a fold, scaled if values are."""
        if self.scaled:
            return list(self.scaled[self.folds if fold is None else fold])
        return self._without(self.totals, fold)

    def _without(self, table: Sequence[Sequence[float]], fold: int | None) -> list[float]:
        """Class sums over all folds but one."""
        return [
            sum(row[c] for j, row in enumerate(table) if j != fold) for c in range(len(self.classes))
        ]

    def log_priors(self, fold: int | None = None) -> list[float]:
        counts = self._without(self.docs, fold)
        return [math.log(n / sum(counts)) if n else -math.inf for n in counts]

    def penalties(self, fold: int | None = None, alpha: float | None = None) -> list[float]:
        """What one unit of any known feature costs, by class."""
        a = self.alpha if alpha is None else alpha
        return [math.log(s / a + self.vocabulary_size) for s in self._masses(fold)]

    def weights(self) -> DataFrame:
        """``label, feature, log_prob`` for the features each class has seen."""
        if self.scaled:
            return self.merged().weights()
        mass = F.array(*[F.lit(s + self.alpha * self.vocabulary_size) for s in self._without(self.totals, None)])
        names = F.array(*[F.lit(c) for c in self.classes])
        rows = self.sums.select("feature", F.inline("cells")).withColumn("s", _total(F.col("s"))).where(F.col("s") > 0)
        return rows.select(
            F.get(names, F.col("c")).alias("label"),
            "feature",
            F.log((F.col("s") + self.alpha) / F.get(mass, F.col("c"))).alias("log_prob"),
        )


def _total(sums: Column) -> Column:
    return F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x)


def _divisor(largest: Column) -> Column:
    """A largest value of 0 leaves 0."""
    return F.when(largest > 0, largest).otherwise(float("inf"))


def _class_number(classes: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1


@dataclass(frozen=True)
class NestedNB:
    """Models of nested parts of the training rows, from one table of sums.

    ``models[p]`` knows the rows whose first part is ``p`` or an earlier one; its
    ``sums`` are those of the last part.  ``dense`` has ``feature, by`` (and
    ``scale``): for every class, part and fold the sum outside the fold and, last,
    of all rows of the part.  ``bytes`` is its size, if it has been measured.
    """

    models: tuple[MultinomialNB, ...]
    dense: DataFrame
    bytes: int | None = None


def fit(
    features: DataFrame,
    docs: DataFrame,
    alpha: float = 1.0,
    train: Column | None = None,
    folds: int = 1,
    max_abs: bool = False,
) -> MultinomialNB:
    """Fit on feature rows and documents that both have a ``label``.

    Rows for which ``train`` is not true, or without a label, add to the
    vocabulary only, as when the vocabulary is taken before the data is split.
    With more than one fold both inputs have a ``fold`` column.  The class
    list and its counts are on the driver, as labels are few next to rows.
    ``max_abs`` divides every feature by its largest value in the training rows.
    """
    nested = _fit(features, docs, alpha, train, folds, max_abs, 1)
    return replace(nested.models[0], ready=nested)


def fit_parts(
    features: DataFrame, docs: DataFrame, parts: int, train: Column | None = None, folds: int = 1, max_abs: bool = False
) -> NestedNB:
    """Models of all parts; both inputs have ``part``, the first of the parts ``0 .. parts - 1`` a row is in, or null."""
    inside = F.col("part").isNotNull()
    train = inside if train is None else train & inside
    return _fit(features, docs, 1.0, train, folds, max_abs, parts)


def _fit(
    features: DataFrame, docs: DataFrame, alpha: float, train: Column | None, folds: int, max_abs: bool, parts: int
) -> NestedNB:
    """Models of the parts.  Their sums have ``feature, cells``: sums by class in lists by fold and, within a fold, part.

    A sum is a column of its own, so features are exchanged once, a row for each
    feature and task.  More classes than fit the columns of a row go in blocks.
    """
    train = F.col("label").isNotNull() & (F.lit(True) if train is None else train)
    fold = F.col("fold") if folds > 1 else F.lit(0)
    place = (fold * parts + F.col("part") if parts > 1 else fold).cast("int")
    cells = folds * parts
    counted = docs.where(train).groupBy("label", place.alias("place")).count().collect()
    classes = sorted({r["label"] for r in counted})
    k = len(classes)
    n_docs = [[0] * k for _ in range(cells)]
    for r in counted:
        n_docs[r["place"]][classes.index(r["label"])] += r["count"]

    wide = max(1, _COLUMNS // cells)  # classes in a row
    blocks = max(1, -(-k // wide))
    own = F.when(train, _class_number(classes))
    used = features.select("feature", own.alias("c"), place.alias("_place"), "value")
    block = F.coalesce(F.floor(F.col("c") / wide), F.lit(0)).cast("int")
    used = used.withColumn("_block", block) if blocks > 1 else used
    group = ["feature", "_block"] if blocks > 1 else ["feature"]
    first = F.col("_block") * wide if blocks > 1 else F.lit(0)
    here = [[(F.col("c") == first + c) & (F.col("_place") == i) for i in range(cells)] for c in range(min(k, wide))]
    sums = [F.sum(F.when(x, F.col("value"))).alias(f"s{c}_{i}") for c, row in enumerate(here) for i, x in enumerate(row)]
    tops = [F.max(F.when(F.col("c").isNotNull() & (F.col("_place") == j), F.abs("value"))).alias(f"_m{j}") for j in range(cells if max_abs else 0)]

    def outside(p: int, j: int) -> list[int]:
        """Places of the rows of a part outside a fold."""
        return [i * parts + q for i in range(folds) if i != j for q in range(p + 1)]

    def cell(c: int) -> Column:
        """The sums of a class, or null if it has no row."""
        each = [F.col(f"s{c}_{i}") for i in range(cells)]
        numbers = F.array(*[F.coalesce(x, F.lit(0.0)) for x in each])
        return F.when(F.coalesce(*each).isNotNull(), F.struct((first + c).cast("int").alias("c"), numbers.alias("s")))

    every = [(p, j) for p in range(parts) for j in range(folds + 1)]
    dense = [
        sum((F.coalesce(F.col(f"s{c}_{i}"), F.lit(0.0)) for i in outside(p, j)), F.lit(0.0)) for c in range(min(k, wide)) for p, j in every
    ]
    none = "array<struct<c:int,s:array<double>>>"
    listed = F.filter(F.array(*[cell(c) for c in range(min(k, wide))]), lambda x: x.isNotNull()) if k else F.array().cast(none)
    by = F.array(*dense) if k else F.array().cast("array<double>")
    counted = used.groupBy(*group).agg(F.lit(0).alias("_z"), *sums, *tops) if sums or tops else used.select(*group).distinct()
    table = counted.select(*group, listed.alias("cells"), by.alias("by"), *[f"_m{j}" for j in range(len(tops))])
    if blocks > 1:
        in_order = F.array_sort(F.collect_list(F.struct("_block", "by", "cells")))
        table = table.groupBy("feature").agg(in_order.alias("_b"), *[F.max(f"_m{j}").alias(f"_m{j}") for j in range(len(tops))])
        width = wide * len(every)
        table = table.withColumns({
            "_d": F.map_from_entries(F.transform("_b", lambda x: F.struct(x["_block"], x["by"]))),
            "cells": F.flatten(F.transform("_b", lambda x: x["cells"])),
        })
        zeros = F.array_repeat(F.lit(0.0), width)
        filled = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_d"), i), zeros))
        table = table.withColumn("by", F.flatten(filled))
    scale = []
    if max_abs:
        seen = [F.coalesce(F.col(f"_m{j}"), F.lit(0.0)) for j in range(cells)]
        scale = [F.array(*[F.greatest(F.lit(0.0), F.lit(0.0), *[seen[i] for i in outside(p, j)]) for p, j in every]).alias("scale")]
    table = staged(table.select("feature", "cells", "by", *scale), "nb")
    names = ["scale"] if max_abs else []
    # of every class: sums by place and, if scaled, scaled sums by part and fold; class -1 stands for the features
    over_all = [F.sum(F.get("s", F.lit(i))) for i in range(cells)]
    if max_abs:
        left = [sum((F.get("s", F.lit(i)) for i in outside(p, j)), F.lit(0.0)) for p, j in every]
        over_all += [F.sum(x / _divisor(F.get("scale", F.lit(i)))) for i, x in enumerate(left)]
    totals = [[0.0] * k for _ in over_all]
    size = letters = 0
    whole = F.array(F.struct(F.lit(-1).alias("c"), F.array().cast("array<double>").alias("s")))
    found = table.select("feature", *names, F.inline(F.concat(whole, F.col("cells"))))
    for r in found.groupBy("c").agg(F.count("*"), F.sum(F.octet_length("feature")), *over_all).collect():
        if r["c"] < 0:
            size, letters = r[1], r[2]
            continue
        for i in range(len(over_all)):
            totals[i][r["c"]] = r[i + 3]
    sums = table.select("feature", "cells", *names)

    def of_part(p: int, table: list[list]) -> tuple[tuple, ...]:
        """Numbers by fold of the rows of a part."""
        return tuple(tuple(sum(table[j * parts + q][c] for q in range(p + 1)) for c in range(k)) for j in range(folds))

    models = []
    for p in range(parts):
        scaled = tuple(map(tuple, totals[cells + p * (folds + 1) : cells + (p + 1) * (folds + 1)])) if max_abs else ()
        models.append(
            MultinomialNB(tuple(classes), of_part(p, n_docs), of_part(p, totals[:cells]), size, sums, alpha, scaled)
        )
    numbers = len(every) * (wide * blocks + (1 if max_abs else 0))
    return NestedNB(tuple(models), table.select("feature", "by", *names), letters + size * (64 + 8 * numbers))


def fit_weighted(features: DataFrame, docs: DataFrame, folds: int) -> tuple[NestedNB, MultinomialNB]:
    """Models of rows whose weights depend on the fold that is left out, and the model of all training rows.

    ``features`` has ``values``: the value of a row as weighted without each fold
    and, last, by all rows.  The sums without a fold add up its own column of
    values.  Rows without a fold only add to the vocabulary.
    """
    train = F.col("fold").isNotNull() & F.col("label").isNotNull()
    counted = docs.where(train).groupBy("label", "fold").count().collect()
    classes = sorted({r["label"] for r in counted})
    k = len(classes)
    n_docs = [[0] * k for _ in range(folds)]
    for r in counted:
        n_docs[r["fold"]][classes.index(r["label"])] += r["count"]
    used = features.select("feature", F.when(train, _class_number(classes)).alias("c"), "fold", "values")
    own = F.col("c").isNotNull()
    sums = [F.sum(F.when(own & (F.col("fold") != j), F.get("values", F.lit(j)))).alias(f"_s{j}") for j in range(folds)]
    sums.append(F.sum(F.when(own, F.get("values", F.lit(folds)))).alias(f"_s{folds}"))
    by_class = used.groupBy("feature", "c").agg(*sums).select(
        "feature", "c", F.array(*[F.coalesce(F.col(f"_s{j}"), F.lit(0.0)) for j in range(folds + 1)]).alias("s")
    )
    cell = F.when(F.col("c").isNotNull(), F.struct("c", "s"))
    cells = staged(by_class.groupBy("feature").agg(F.collect_list(cell).alias("cells")), "nb")
    totals = [[0.0] * k for _ in range(folds + 1)]
    for r in cells.select(F.inline("cells")).groupBy("c").agg(*[F.sum(F.get("s", F.lit(j))) for j in range(folds + 1)]).collect():
        for j in range(folds + 1):
            totals[j][r["c"]] = r[j + 1]
    size = cells.count()
    folded = MultinomialNB(
        tuple(classes), tuple(map(tuple, n_docs)), (), size, cells, 1.0, tuple(map(tuple, totals))
    )
    seen = F.map_from_entries(F.transform("cells", lambda x: F.struct(x["c"], x["s"])))
    none = F.array(*[F.lit(0.0)] * (folds + 1))
    order = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")
    by = F.flatten(F.transform(order, lambda c: F.coalesce(F.try_element_at(F.col("_cells"), c), none)))
    ones = F.array(*[F.lit(1.0)] * (folds + 1)).alias("scale")
    dense = staged(cells.withColumn("_cells", seen).select("feature", by.alias("by"), ones), "dense")
    last = F.transform("cells", lambda x: F.struct(x["c"].alias("c"), F.array(F.get(x["s"], F.lit(folds))).alias("s")))
    whole = MultinomialNB(
        tuple(classes), (tuple(sum(x[c] for x in n_docs) for c in range(k)),), (tuple(totals[-1]),), size,
        staged(cells.select("feature", last.alias("cells")), "nb"),
    )
    return NestedNB((folded,), dense), whole


def softmax(scores: Column) -> Column:
    """Probabilities from an array of log scores."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.transform(scores, lambda s: F.exp(s - top) / total)


def best_of(classes: Sequence[str], scores: Column) -> Column:
    """Label of the highest score, the first one on equal scores."""
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.get(F.array(*[F.lit(c) for c in classes]), at)


def score(
    features: DataFrame,
    model: MultinomialNB,
    keep: Sequence[str] = (),
    fold: str | None = None,
    alphas: Sequence[float] | None = None,
    docs: DataFrame | None = None,
    **join,
) -> DataFrame:
    """``doc_id, *keep, alpha, scores, predicted``: log scores by class.

    Rows of ``docs`` without a feature get the class shares; without ``docs``
    only documents that have feature rows are scored.  With ``fold``, a row is
    scored by the model without its fold; rows whose fold is null are scored by
    the whole model.  Several smoothing values are scored by the same join.
    """
    nested = NestedNB((model,), *_known(model))
    return score_parts(features, nested, keep, fold, [model.alpha] if alphas is None else alphas, docs, **join).drop("part")


def score_parts(
    features: DataFrame,
    nested: NestedNB,
    keep: Sequence[str] = (),
    fold: str | None = None,
    alphas: Sequence[float] = (1.0,),
    docs: DataFrame | None = None,
    **join,
) -> DataFrame:
    """``doc_id, *keep, part, alpha, scores, predicted``: the scores of every row by the model of every part.

    One join with the sums and one exchange of a row for each document and task,
    whatever the number of classes, folds, parts and smoothing values.
    """
    ids = ["doc_id", *keep] + ([fold] if fold and fold not in keep else [])
    models, table = nested.models, nested.dense
    k, folds, parts = len(models[0].classes), models[0].folds, len(models)
    at = (F.coalesce(F.col(fold), F.lit(folds)) if fold else F.lit(folds)).cast("int")
    join = {"table_bytes": nested.bytes, **join}
    known = lookup_join(features, table, ["feature"], "left", row_bytes=64 + 8 * k * parts * (folds + 1), **join)
    known = known.where("by IS NOT NULL").withColumn("_at", at)

    def scale(p: int) -> Column:
        return _divisor(F.get("scale", p * (folds + 1) + F.col("_at"))) if models[0].scaled else F.lit(1.0)

    # one number for each class, part and smoothing value, and the sum of known values.  More classes than fit the
    # columns of a row go in blocks
    settings = [(p, a) for p in range(parts) for a in alphas]
    wide = max(1, _COLUMNS // len(settings))
    blocks = -(-k // wide)
    if blocks > 1:
        known = known.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = F.col("_block") * wide if blocks > 1 else F.lit(0)
    sums = [F.sum(F.col("value") / scale(p)).alias(f"m{p}") for p in range(parts)]
    for c in range(min(k, wide)):
        for i, (p, a) in enumerate(settings):
            mass = F.get("by", ((first + c) * parts + p) * (folds + 1) + F.col("_at")) / scale(p)
            gain = F.col("value") / scale(p) * F.log(mass / a + 1.0)
            sums.append(F.sum(F.when(mass > 0, gain)).alias(f"g{c}_{i}"))
    group = ["doc_id", "_block"] if blocks > 1 else ["doc_id"]
    lists = [
        F.array(*[F.coalesce(F.col(f"g{c}_{i}"), F.lit(0.0)) for c in range(min(k, wide))]).alias(f"g{i}")
        for i in range(len(settings))
    ]
    found = known.groupBy(*group).agg(*sums).select(*group, *[f"m{p}" for p in range(parts)], *lists)
    if blocks > 1:
        ordered = F.array_sort(F.collect_list(F.struct("_block", *[f"g{i}" for i in range(len(settings))])))
        found = found.groupBy("doc_id").agg(*[F.max(f"m{p}").alias(f"m{p}") for p in range(parts)], ordered.alias("_all"))
        found = found.select("*", *[F.flatten(F.col(f"_all.g{i}")).alias(f"g{i}") for i in range(len(settings))])
    every = features.select(*ids).distinct() if docs is None else docs.select(*ids)
    found = found.select(
        F.col("doc_id").alias("_id"), *[f"m{p}" for p in range(parts)], *[f"g{i}" for i in range(len(settings))]
    )
    found = every.join(found, every["doc_id"] == F.col("_id"), "left")

    def by_fold(values) -> Column:
        """Numbers by class that depend on the fold; rows without a fold use all."""
        if fold is None:
            return F.lit(values(None))
        table = F.array(*[F.lit(values(j)) for j in [*range(folds), None]])
        return F.get(table, F.coalesce(F.col(fold), F.lit(folds)))

    def log_scores(i: int, p: int, a: float) -> Column:
        model = models[p]
        fixed = F.arrays_zip(by_fold(model.log_priors).alias("p"), by_fold(lambda j: model.penalties(j, a)).alias("q"))
        gained = lambda c: F.coalesce(F.get(f"g{i}", c), F.lit(0.0))
        mass = F.coalesce(F.col(f"m{p}"), F.lit(0.0))
        return F.transform(fixed, lambda x, c: x["p"] - mass * x["q"] + gained(c))

    results = [
        F.struct(F.lit(p).alias("part"), F.lit(float(a)).alias("alpha"), log_scores(i, p, a).alias("scores"))
        for i, (p, a) in enumerate(settings)
    ]
    scored = found.select(*ids, F.inline(F.array(*results)))
    return scored.withColumn("predicted", best_of(models[0].classes, F.col("scores")))


def _known(model: MultinomialNB) -> tuple[DataFrame, int | None]:
    """The dense sums of a model and their size, if it was fitted here."""
    if model.ready is not None:
        return model.ready.dense, model.ready.bytes
    return _dense((model,), model.sums, 1), None


def _dense(models: Sequence[MultinomialNB], sums: DataFrame, parts: int) -> DataFrame:
    """``feature, by`` (``scale``) as in ``NestedNB``."""
    folds, k = models[0].folds, len(models[0].classes)
    cells = F.map_from_entries(F.transform("cells", lambda x: F.struct(x["c"], x["s"])))

    def of_class(c: Column) -> Column:
        s = F.coalesce(F.try_element_at(F.col("_cells"), c), F.array(*[F.lit(0.0)] * (folds * parts)))
        upto = lambda p, j: sum((F.get(s, F.lit(j * parts + q)) for q in range(p + 1)), F.lit(0.0))
        each = []
        for p in range(parts):
            by_fold = [upto(p, j) for j in range(folds)]
            each += [sum((x for i, x in enumerate(by_fold) if i != j), F.lit(0.0)) for j in range(folds)]
            each.append(sum(by_fold, F.lit(0.0)))
        return F.array(*each)

    by = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of_class)) if k else F.array().cast("array<double>")
    columns = ["scale"] if models[0].scaled else []
    return staged(sums.withColumn("_cells", cells).select("feature", by.alias("by"), *columns), "dense")


def cross_fit(
    features: DataFrame,
    docs: DataFrame,
    folds: int,
    alphas: Sequence[float] = (1.0,),
    keep: Sequence[str] = (),
    train: Column | None = None,
    asked: Column | None = None,
    max_abs: bool = False,
    **join,
) -> tuple[DataFrame, MultinomialNB]:
    """Every document scored by a model that has not seen its fold, and that
    model with its folds; ``merged`` is the one of all training rows.

    ``features`` is read twice: once for the sums, once for the scores of the
    rows that are ``asked`` for.  Every row of ``docs`` that is asked for gets a
    score, also without a feature.
    """
    ids = list(dict.fromkeys(["fold", *keep]))
    wanted, every = (features, docs) if asked is None else (features.where(asked), docs.where(asked))
    model = fit(features, docs, train=train, folds=folds, max_abs=max_abs)
    return score(wanted, model, ids, "fold", alphas, docs=every, **join), model


def out_of_fold(*args, **kwargs) -> DataFrame:
    """The scores of ``cross_fit``."""
    return cross_fit(*args, **kwargs)[0]
