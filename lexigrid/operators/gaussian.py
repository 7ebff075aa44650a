"""Gaussian naive Bayes over sparse features, with cross validation from one table of moments.

Absent values are zeros and count towards means and variances, so a class is
described by the moments of the rows that exist, merged with a block of zeros.
Moments (count, mean, variance) are kept by feature, class and fold.  A model
without a fold merges those of the other folds; nothing is ever taken off a
total, so large values keep their variance.  A document's score starts from
the score of an all-zero document and is corrected for the values it has.  The
correction would cancel badly where values are large and never zero, such as
time stamps: features that every training row has are left out of the start
and counted directly; only a document that lacks one gets their zero terms.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators.lookup import lookup_join
from lexigrid.operators.naive_bayes import _class_number, best_of
from lexigrid.session import staged


@dataclass(frozen=True)
class GaussianNB:
    """Models without each fold and, last, of all training rows.

    ``moments`` has ``feature`` and ``by``: for every model arrays ``mean``, ``var``
    by class, ``full``: no training row of the model lacks the feature, and ``scale``,
    which values are divided by.  ``base``
    scores an all-zero document by model and class without the ``n_full`` full
    features, ``rest`` adds these.
    """

    classes: tuple[str, ...]
    base: tuple[tuple[float, ...], ...]
    moments: DataFrame
    rest: tuple[tuple[float, ...], ...] = ()
    n_full: tuple[int, ...] = ()

    @property
    def folds(self) -> int:
        return len(self.base) - 1

    def merged(self) -> "GaussianNB":
        """The model of all training rows alone."""
        last = F.array(F.get("by", F.lit(self.folds)))
        return GaussianNB(
            self.classes, self.base[-1:], self.moments.select("feature", last.alias("by")), self.rest[-1:], self.n_full[-1:]
        )


def _sum(items: Column, pick) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + pick(x))


def _merged(parts: Column) -> Column:
    """Moments of several blocks of rows as those of one."""
    n = _sum(parts, lambda x: x["n"])
    mean = F.when(n > 0, _sum(parts, lambda x: x["n"] * x["m"]) / n).otherwise(0.0)
    at = F.struct(n.alias("n"), mean.alias("m"))
    spread = lambda s: _sum(parts, lambda x: x["n"] * (x["v"] + (x["m"] - s["m"]) * (x["m"] - s["m"])))
    return F.get(
        F.transform(
            F.array(at),
            lambda s: F.struct(s["n"].alias("n"), s["m"].alias("m"), F.when(s["n"] > 0, spread(s) / s["n"]).otherwise(0.0).alias("v")),
        ),
        F.lit(0),
    )


def fit(
    features: DataFrame, docs: DataFrame, smoothing: float = 1e-9, train: Column | None = None, folds: int = 1, max_abs: bool = False
) -> GaussianNB:
    """Class means and variances; ``smoothing`` times the largest overall
    variance is added to every variance.

    With more than one fold both inputs have a ``fold`` column, and there is a
    model without each fold as well.  Rows for which ``train`` is not true take
    no part.  ``max_abs`` divides every feature by its largest value in the rows
    of the model.  Rows may have ``values`` instead: what they are worth without
    each fold and, last, to the model of all.
    """
    if train is not None:
        features, docs = features.where(train), docs.where(train)
    fold = F.col("fold") if folds > 1 else F.lit(0)
    counted = docs.groupBy("label", fold.cast("int").alias("fold")).count().collect()
    classes = sorted({r["label"] for r in counted})
    k = len(classes)
    sizes = [[0] * k for _ in range(folds)]
    for r in counted:
        sizes[r["fold"]][classes.index(r["label"])] += r["count"]
    models = [*range(folds), None] if folds > 1 else [None]
    held = [[sum(s[c] for i, s in enumerate(sizes) if i != j) for c in range(k)] for j in models]

    keyed = features.select("*", _class_number(classes).alias("c"), fold.cast("int").alias("f"))
    own = "values" in features.columns
    if own:  # a column of values for each model: its rows are counted for it alone
        models_of = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(models) - 1)), lambda i: (i == len(models) - 1) | (i != F.col("f"))))
        keyed = keyed.withColumn("f", models_of).withColumn("value", F.get("values", F.col("f")))
    seen = keyed.groupBy("feature", "c", "f").agg(
        F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.max(F.abs("value")).alias("t")
    )
    cells = staged(seen.groupBy("feature").agg(F.collect_list(F.struct("c", "f", "n", "m", "v", "t")).alias("cells")), "gauss")
    sequence = F.sequence(F.lit(0), F.lit(k - 1)) if k else F.array().cast("array<int>")

    def model(i: int, j: int | None) -> Column:
        """Moments by class outside a fold, the absent zeros merged in without cancellation."""
        outside = F.col("cells") if j is None else F.filter("cells", lambda x: x["f"] != j)
        if own:
            outside = F.filter("cells", lambda x: x["f"] == i)
        counts = F.array(*[F.lit(float(n)) for n in held[i]])

        def of_class(c: Column) -> Column:
            x, size = _merged(F.filter(outside, lambda x: x["c"] == c)), F.get(counts, c)
            some = size > 0
            n, m, v = x["n"], x["m"], x["v"]
            mean = F.when(some, n * m / size).otherwise(0.0)
            var = F.when(some, n * v / size + m * m * n * (size - n) / (size * size)).otherwise(0.0)
            return F.struct((mean / by).alias("mean"), (var / by / by).alias("var"))

        top = F.aggregate(outside, F.lit(0.0), lambda acc, x: F.greatest(acc, x["t"]))
        by = F.when(top > 0, top).otherwise(float("inf")) if max_abs else F.lit(1.0)
        everything = _sum(outside, lambda x: x["n"]) == float(sum(held[i]))
        return F.struct(everything.alias("full"), by.alias("scale"), F.transform(sequence, of_class).alias("x"))

    found = staged(cells.select("feature", F.array(*[model(i, j) for i, j in enumerate(models)]).alias("by")), "gauss")

    def spread(i: int) -> Column:
        """The overall variance: within classes and between their means."""
        total = float(sum(held[i])) or 1.0
        weights = F.array(*[F.lit(n / total) for n in held[i]])
        share = F.zip_with(F.get("by", F.lit(i))["x"], weights, lambda x, w: F.struct(w.alias("w"), x["mean"].alias("m"), x["var"].alias("v")))
        middle = _sum(share, lambda x: x["w"] * x["m"])
        return _sum(share, lambda x: x["w"] * (x["v"] + (x["m"] - middle) * (x["m"] - middle)))

    largest = [x or 0.0 for x in found.agg(*[F.max(spread(i)) for i in range(len(models))]).first()]
    if k and not largest[-1] > 0:
        raise ValueError("no feature varies")
    smooth = F.array(*[F.lit(smoothing * (x or largest[-1])) for x in largest])

    def smoothed(b: Column, i: Column) -> Column:
        return F.struct(
            b["full"].alias("full"),
            b["scale"].alias("scale"),
            F.transform(b["x"], lambda x: x["mean"]).alias("mean"),
            F.transform(b["x"], lambda x: x["var"] + F.get(smooth, i)).alias("var"),
        )

    moments = staged(found.select("feature", F.transform("by", smoothed).alias("by")), "gauss")
    sums = []
    for i in range(len(models)):
        b = F.get("by", F.lit(i))
        sums.append(F.count_if(b["full"]))
        sums += [
            F.sum(F.when(b["full"] == full, _term(F.lit(0.0), b, c)).otherwise(0.0)) for full in (False, True) for c in range(k)
        ]
    row, width = moments.agg(*sums).first(), 1 + 2 * k
    base, rest, n_full = [], [], []
    for i in range(len(models)):
        part = row[i * width : (i + 1) * width]
        total = sum(held[i])
        priors = [math.log(n / total) if n else -math.inf for n in held[i]]
        base.append(tuple(p + (part[1 + c] or 0.0) for c, p in enumerate(priors)))
        rest.append(tuple(part[1 + k + c] or 0.0 for c in range(k)))
        n_full.append(part[0])
    return GaussianNB(tuple(classes), tuple(base), moments, tuple(rest), tuple(n_full))


def _term(x: Column, by: Column, c: int) -> Column:
    """Log density of a value in a class."""
    mean, var = F.get(by["mean"], F.lit(c)), F.get(by["var"], F.lit(c))
    return -0.5 * F.log(2 * math.pi * var) - (x - mean) * (x - mean) / (2 * var)


def score(
    features: DataFrame,
    model: GaussianNB,
    keep: Sequence[str] = (),
    docs: DataFrame | None = None,
    fold: str | None = None,
    **join,
) -> DataFrame:
    """``doc_id, *keep, scores, predicted``; rows of ``docs`` without a feature are all zeros.

    Without ``docs`` only documents that have feature rows are scored.  With
    ``fold``, a row is scored by the model without its fold, or by the model of
    all rows if it has none.
    """
    k = len(model.classes)
    ids = ["doc_id", *keep] + ([fold] if fold and fold not in keep else [])
    last = F.lit(model.folds)
    at = F.coalesce(F.col(fold), last) if fold else last
    known = lookup_join(features, model.moments, ["feature"], "left", row_bytes=64 + 16 * k * len(model.base), **join)
    known = known.withColumn("_m", F.get("by", at))
    if "values" in features.columns:
        known = known.withColumn("value", F.get("values", at))
    here = [_term(F.col("value") / F.col("_m.scale"), F.col("_m"), c) for c in range(k)]
    zero = [_term(F.lit(0.0), F.col("_m"), c) for c in range(k)]
    full = F.col("_m.full")
    gains = [F.sum(F.when(full, p).otherwise(p - z)).alias(f"_g{c}") for c, (p, z) in enumerate(zip(here, zero))]
    had = [F.sum(F.when(full, z)).alias(f"_z{c}") for c, z in enumerate(zero)]
    every = features.select(*ids).distinct() if docs is None else docs.select(*ids)
    sums = known.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if(full).alias("_n"), *gains, *had)
    sums = every.join(sums, every["doc_id"] == F.col("_id"), "left")

    def of_model(values: Sequence) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    def total(c: int) -> Column:
        lacks = F.coalesce("_n", F.lit(0)) < of_model(model.n_full)
        missed = F.when(lacks, of_model([r[c] for r in model.rest]) - F.coalesce(F.col(f"_z{c}"), F.lit(0.0))).otherwise(0.0)
        return of_model([b[c] for b in model.base]) + F.coalesce(F.col(f"_g{c}"), F.lit(0.0)) + missed

    scores = F.array(*[total(c) for c in range(k)])
    return sums.select(*ids, scores.alias("scores")).withColumn("predicted", best_of(model.classes, F.col("scores")))


def cross_fit(
    features: DataFrame, docs: DataFrame, folds: int, keep: Sequence[str] = (), smoothing: float = 1e-9, train: Column | None = None,
    asked: Column | None = None, max_abs: bool = False, **join,
) -> tuple[DataFrame, GaussianNB]:
    """Every document that is asked for, scored by a model that has not seen its fold, and that model with its folds."""
    model = fit(features, docs, smoothing, train, folds, max_abs)
    ids = list(dict.fromkeys(["fold", *keep]))
    wanted, every = (features, docs) if asked is None else (features.where(asked), docs.where(asked))
    return score(wanted, model, ids, every, "fold", **join), model
