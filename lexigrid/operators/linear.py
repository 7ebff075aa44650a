"""Linear support vector machines: every class, fold and penalty at once.

Cross validation over a grid asks for ``classes x (folds + 1) x penalties``
machines on the same rows.  Here they are the columns of one matrix of weights:
a pass over the vectors gives loss and gradient of all of them, and a
quasi-Newton step (L-BFGS, with a line search for each column) moves all of
them.  Columns that have converged drop out.  So the number of Spark jobs is
that of the steps, some tens, whatever the size of the grid.

A machine minimises ``|w|^2 / 2 + C * sum(hinge)``; the hinge is rounded off
over the last ``SMOOTH`` before it reaches zero, so that it has a gradient, and
the intercept is not penalised.  With max-abs scaling or TF-IDF every fold has
its own scale; it goes into the weights, and the vectors stay as they are.
Lengths that rows are divided by are a list by fold beside the vector.

Tasks add up what they read and hand on one matrix each; the vectors are read
by as many tasks as there are cores, and matrices that together are large are
added up in Spark.  ``BLOCK`` bounds the numbers in one matrix: more columns
than fit are worked through in blocks.

Probabilities come from a logistic fit on margins out of fold, so no row
calibrates a machine that it has trained.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.operators.lookup import lookup_join
from lexigrid.operators.naive_bayes import best_of
from lexigrid.session import staged

SMOOTH = 0.2
BLOCK = 1 << 21
HISTORY = 6
_TERMS = 1 << 21  # products of values and weights held at once in a task
_GATHERED = 64 << 20  # bytes of matrices that the driver adds up itself
_PART = 1 << 16  # numbers in a row of a matrix on its way


def sparse_rows(cells: DataFrame, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, *keep, idx, val``: the cells of every row of ``docs`` as two arrays, empty without cells."""
    gathered = cells.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_c"))
    rows = docs.select("doc_id", *keep).join(gathered, F.col("doc_id") == F.col("_id"), "left")
    none = F.array().cast("array<struct<idx:int,value:double>>")
    cell = F.coalesce(F.col("_c").cast("array<struct<idx:int,value:double>>"), none)
    return staged(rows.select("doc_id", *keep, cell["idx"].alias("idx"), cell["value"].alias("val")).hint("rebalance"), "rows")


@dataclass(frozen=True)
class Machines:
    """Weights of all machines: ``weights[feature, machine]``, the intercept last.

    ``fold`` is the fold a machine has not seen, or the number of folds;
    ``setting`` the place of its penalty, ``label`` its class.
    """

    classes: tuple[str, ...]
    folds: int
    penalties: tuple[float, ...]
    fold: np.ndarray
    setting: np.ndarray
    label: np.ndarray
    weights: np.ndarray

    def of(self, fold: int, setting: int) -> np.ndarray:
        """Weights of the classes, in order; of two classes only the second has a machine."""
        return self.weights[:, (self.fold == fold) & (self.setting == setting)]


def _batches(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their cells: ``(rows, row of each cell, idx, val)``."""
    lengths = pa.compute.list_value_length(batch.column("idx")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    val = batch.column("val").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit, at = max(1, _TERMS // width), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + limit, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
        cells = slice(int(base), int(ends[to - 1]))
        yield slice(at, to), np.repeat(np.arange(to - at), lengths[at:to]), idx[cells], val[cells]
        at = to


def _products(n: int, row: np.ndarray, idx: np.ndarray, val: np.ndarray, weights: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Margins of ``n`` rows: the sparse rows times the weights, by their lengths, the intercept added."""
    out = np.zeros((n, weights.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(weights[idx] * val[:, None], starts)
    return out * share + weights[-1]


def _shares(batch: pa.RecordBatch, fold: np.ndarray) -> np.ndarray | None:
    """What each machine multiplies a row by: one over its length, as seen without the fold of the machine."""
    if "norm" not in batch.schema.names:
        return None
    norm = np.array(batch.column("norm").to_pylist(), np.float64).reshape(batch.num_rows, -1)
    return np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)[:, fold]


def _hinge(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and what it falls by, by margin."""
    slack = 1 - margins
    slope = np.clip(slack / SMOOTH, 0, 1)
    return slope * (slack - slope * (SMOOTH / 2)), slope


def _row(rows: DataFrame) -> list[str]:
    return ["idx", "val", *(["norm"] if "norm" in rows.columns else [])]


def losses(rows: DataFrame, weights: np.ndarray, fold: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of losses and its gradient for each column of ``weights``, from one pass over ``rows(y, fold, idx, val)``.

    A column takes part in the rows outside its fold; its class is the positive one.
    """
    shape, spark = weights.shape, rows.sparkSession
    shared = spark.sparkContext.broadcast((weights, fold, label))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, fold, label = shared.value
        total = np.zeros((shape[0] + 1, shape[1]))  # the losses last
        for batch in batches:
            ys = batch.column("y").to_numpy(zero_copy_only=False)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            shares = _shares(batch, fold)
            for at, row, idx, val in _batches(batch, shape[1]):
                sign = np.where(ys[at, None] == label, 1.0, -1.0)
                share = 1.0 if shares is None else shares[at]
                loss, slope = _hinge(sign * _products(at.stop - at.start, row, idx, val, weights, share))
                mine = folds[at, None] != fold
                pull = np.where(mine, -sign * slope, 0.0)
                total[-1] += np.where(mine, loss, 0.0).sum(0)
                total[-2] += pull.sum(0)
                pull = pull * share
                if len(idx):
                    order = np.argsort(idx, kind="stable")
                    starts = np.flatnonzero(np.diff(idx[order], prepend=-1))
                    total[idx[order[starts]]] += np.add.reduceat(pull[row[order]] * val[order, None], starts)
        flat = total.ravel()
        parts = range(0, len(flat), _PART)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([flat[p : p + _PART].tobytes() for p in parts], pa.binary())],
            names=["part", "sums"],
        )

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [sum(np.frombuffer(x) for x in group["sums"]).tobytes()]})

    found = rows.select("y", "fold", *_row(rows)).mapInArrow(walk, "part int, sums binary")
    if rows.rdd.getNumPartitions() * (shape[0] + 1) * shape[1] * 8 > _GATHERED:
        found = found.groupBy("part").applyInPandas(add, "part int, sums binary")
    sums = np.zeros((shape[0] + 1) * shape[1])
    for r in found.collect():  # _GATHERED bytes, or one matrix
        part = np.frombuffer(r["sums"])
        sums[r["part"] * _PART : r["part"] * _PART + len(part)] += part
    shared.destroy()
    sums = sums.reshape(shape[0] + 1, shape[1])
    return sums[-1], sums[:-1]


def minimise(
    value: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, columns: int, passes: int, tol: float
) -> np.ndarray:
    """Columns that minimise a convex function each; ``value(points, which)`` evaluates several of them at once.

    L-BFGS: a column whose step does not lower its function enough halves it,
    the others go on; it ends where its gradient has shrunk to ``tol`` of the first.
    """
    w = np.zeros((size, columns))
    which = np.arange(columns)
    f, g = value(w, which)
    first = np.maximum(np.linalg.norm(g, axis=0), 1e-12)
    steps, turns = np.zeros((2, HISTORY, size, columns))
    rho = np.zeros((HISTORY, columns))
    direction = -g
    length = 1 / np.maximum(1.0, first)
    active = first > 1e-10
    for _ in range(passes):
        which = np.flatnonzero(active)
        if not len(which):
            break
        trial = w[:, which] + length[which] * direction[:, which]
        f_new, g_new = value(trial, which)
        slope = (g[:, which] * direction[:, which]).sum(0)
        down = f_new <= f[which] + 1e-4 * length[which] * slope
        length[which[~down]] *= 0.3
        active[which[~down]] &= length[which[~down]] > 1e-8
        moved = which[down]
        if not len(moved):
            continue
        s, y = trial[:, down] - w[:, moved], g_new[:, down] - g[:, moved]
        w[:, moved], f[moved], g[:, moved] = trial[:, down], f_new[down], g_new[:, down]
        bend = (s * y).sum(0)
        kept = bend > 1e-12 * (y * y).sum(0)
        to = moved[kept]
        for table, new in ((steps, s), (turns, y)):
            table[:-1, :, to] = table[1:, :, to]
            table[-1, :, to] = new[:, kept].T
        rho[:-1, to] = rho[1:, to]
        rho[-1, to] = 1 / bend[kept]
        q = g[:, moved].copy()
        ratios = []
        for h in range(HISTORY - 1, -1, -1):
            a = rho[h, moved] * (steps[h][:, moved] * q).sum(0)
            q -= a * turns[h][:, moved]
            ratios.append(a)
        size_of = (turns[-1][:, moved] ** 2).sum(0) * rho[-1, moved]
        q /= np.where(size_of > 0, size_of, 1.0)
        for h, a in zip(range(HISTORY), reversed(ratios)):
            b = rho[h, moved] * (turns[h][:, moved] * q).sum(0)
            q += (a - b) * steps[h][:, moved]
        direction[:, moved] = -q
        length[moved] = 1.0
        active[moved] = np.linalg.norm(g[:, moved], axis=0) > tol * first[moved]
    return w


def fit_all(
    rows: DataFrame,
    size: int,
    classes: Sequence[str],
    folds: int,
    penalties: Sequence[float],
    scale: np.ndarray | None = None,
    passes: int = 100,
    tol: float = 1e-3,
) -> Machines:
    """Machines of every class and penalty, without each fold and on all rows.

    ``rows`` has ``label, fold, idx, val``, training rows only; ``scale`` has a
    row of divisors for each fold and, last, for all rows.
    """
    names = F.array(*[F.lit(c) for c in classes])
    y = (F.array_position(names, F.col("label")) - 1).cast("int").alias("y")
    rows = rows.select(y, F.coalesce("fold", F.lit(-1)).cast("int").alias("fold"), *_row(rows))
    rows = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)).persist()
    counts = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    total = sum(counts.values())
    positive = range(len(classes)) if len(classes) > 2 else range(1, len(classes))
    every = [(j, i, c) for j in range(folds + 1) for i in range(len(penalties)) for c in positive]
    fold, setting, label = (np.array(x, np.int64) for x in zip(*every)) if every else (np.zeros(0, np.int64),) * 3
    seen = np.array([total - (counts.get(j, 0) if j < folds else 0) for j in fold], np.float64)
    weights = np.zeros((size + 1, len(every)))
    block = max(1, BLOCK // (size + 1))
    for start in range(0, len(every), block):
        mine = np.arange(start, min(len(every), start + block))
        by = np.ones((size + 1, len(mine)))
        if scale is not None:
            by[:-1] = scale[fold[mine]].T
        n = np.maximum(1.0, seen[mine])
        penalty = 1 / (np.array(penalties)[setting[mine]] * n)

        def value(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            loss, gradient = losses(rows, points / by[:, which], fold[mine[which]], label[mine[which]])
            slopes = points * penalty[which]
            slopes[-1] = 0
            length = (points[:-1] ** 2).sum(0)
            return loss / n[which] + penalty[which] * length / 2, gradient / by[:, which] / n[which] + slopes

        weights[:, mine] = minimise(value, size + 1, len(mine), passes, tol) / by
    rows.unpersist()
    return Machines(tuple(classes), folds, tuple(penalties), fold, setting, label, weights)


def margins(rows: DataFrame, machines: Machines, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, *keep, setting, margins, predicted``: every row by the machines without its fold, or by those of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(machines)
    n, k = len(machines.penalties), len(machines.classes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = shared.value
        for batch in batches:
            folds = batch.column("fold").fill_null(machines.folds).to_numpy(zero_copy_only=False)
            shares = _shares(batch, machines.fold)
            out = np.zeros((batch.num_rows, n, k))
            for at, row, idx, val in _batches(batch, len(machines.fold)):
                found = _products(at.stop - at.start, row, idx, val, machines.weights, 1.0 if shares is None else shares[at])
                for j in np.unique(folds[at]).tolist():
                    these = np.flatnonzero(folds[at] == j)
                    some = found[these][:, machines.fold == j].reshape(len(these), n, -1)
                    out[at.start + these] = some if k != 2 else np.concatenate([-some, some], axis=2)
            flat = pa.array(out.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * n + 1) * k, pa.int32()), flat)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), lists)
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", *keep, "margins"])

    read = rows.select("doc_id", *keep, *([] if "fold" in keep else ["fold"]), *_row(rows))
    fields = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    made = read.mapInArrow(walk, f"{fields}, margins array<array<double>>")
    each = made.select("doc_id", *keep, F.posexplode("margins").alias("setting", "margins"))
    return each.withColumn("predicted", best_of(machines.classes, F.col("margins")))


def calibrated(scored: DataFrame, classes: Sequence[str], steps: int = 30) -> list[tuple[float, float]]:
    """Slope and offset by class of a logistic curve from margins to chances.

    ``scored(label, margins)`` are margins of rows that the machine has not
    seen.  Newton's method; a pass adds up six numbers for each class.  Targets
    are drawn in by one row each, so separable margins have a solution.
    """
    k = len(classes)
    names = F.array(*[F.lit(c) for c in classes])
    rows = staged(scored.select((F.array_position(names, F.col("label")) - 1).alias("y"), "margins"), "margins")
    counts = [0] * k
    for r in rows.groupBy("y").count().collect():
        counts[r["y"]] = r["count"]
    total = sum(counts)
    at = [(0.0, math.log((total - n + 1) / (n + 1))) for n in counts]  # p = 1 / (1 + exp(a m + b))
    found, best, damp = list(at), [math.inf] * k, [1e-6] * k
    for _ in range(steps):
        sums = []
        for c, (a, b) in enumerate(at):
            m = F.get("margins", F.lit(c))
            t = F.when(F.col("y") == c, (counts[c] + 1.0) / (counts[c] + 2.0)).otherwise(1.0 / (total - counts[c] + 2.0))
            z = m * a + b
            p = 1 / (1 + F.exp(z))
            loss = t * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
            w = p * (1 - p)
            sums += [F.sum(x) for x in (loss, (t - p) * m, t - p, w * m * m, w * m, w)]
        row = [x or 0.0 for x in rows.agg(*sums).first()]
        settled = True
        for c in range(k):
            loss, ga, gb, haa, hab, hbb = row[6 * c : 6 * c + 6]
            if loss <= best[c]:
                settled &= best[c] - loss <= 1e-10 * max(1.0, abs(loss))
                best[c], found[c], damp[c] = loss, at[c], damp[c] / 4
                haa, hbb = haa + damp[c], hbb + damp[c]
                det = haa * hbb - hab * hab
                step = ((hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det) if det > 0 else (ga, gb)
                at[c] = (found[c][0] - step[0], found[c][1] - step[1])
            else:  # too far
                settled = False
                at[c] = tuple((x + y) / 2 for x, y in zip(at[c], found[c]))
        if settled:
            break
    return found


@dataclass(frozen=True)
class LinearSVM:
    """The machines of one penalty on all training rows: ``weights(feature, by)`` by class, and their calibration."""

    classes: tuple[str, ...]
    intercepts: tuple[float, ...]
    weights: DataFrame
    curves: tuple[tuple[float, float], ...]


def chosen(
    machines: Machines, setting: int, vocabulary: DataFrame, scored: DataFrame, scale: np.ndarray | None = None
) -> LinearSVM:
    """The machines of a penalty with the features' names; ``scored`` are margins out of fold, of all penalties.

    They read plain values, or values that are divided by ``scale`` already.
    """
    w = machines.of(machines.folds, setting)
    w = w if scale is None else np.concatenate([w[:-1] * scale[:, None], w[-1:]])
    w = w if len(machines.classes) != 2 else np.concatenate([-w, w], axis=1)
    spark = vocabulary.sparkSession
    k = w.shape[1]
    table = pa.table({
        "idx": pa.array(np.arange(len(w) - 1), pa.int64()),
        "by": pa.ListArray.from_arrays(pa.array(np.arange(len(w)) * k, pa.int32()), pa.array(w[:-1].ravel())),
    })
    named = vocabulary.join(spark.createDataFrame(table), "idx").select("feature", "by")
    curves = calibrated(scored.where(F.col("setting") == setting), machines.classes)
    return LinearSVM(machines.classes, tuple(w[-1].tolist()), staged(named, "svm"), tuple(curves))


def score(features: DataFrame, model: LinearSVM, keep: Sequence[str] = (), docs: DataFrame | None = None, **join) -> DataFrame:
    """``doc_id, *keep, margins, proba, predicted`` from feature rows; probabilities are a list by class."""
    k = len(model.classes)
    known = lookup_join(features, model.weights, ["feature"], row_bytes=64 + 8 * k, **join)
    sums = known.groupBy(F.col("doc_id").alias("_id")).agg(
        *[F.sum(F.col("value") * F.get("by", F.lit(c))).alias(f"_m{c}") for c in range(k)]
    )
    every = features.select("doc_id", *keep).distinct() if docs is None else docs.select("doc_id", *keep)
    found = every.join(sums, every["doc_id"] == F.col("_id"), "left")
    each = [F.coalesce(F.col(f"_m{c}"), F.lit(0.0)) + model.intercepts[c] for c in range(k)]
    found = found.select("doc_id", *keep, F.array(*each).alias("margins"))
    return found.select("*", chances(model).alias("proba"), best_of(model.classes, F.col("margins")).alias("predicted"))


def chances(model: LinearSVM) -> Column:
    """Calibrated chances by class, which add up to one."""
    curve = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in model.curves])
    raw = F.zip_with("margins", curve, lambda m, c: 1 / (1 + F.exp(m * c["a"] + c["b"])))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raw, lambda x: F.when(total > 0, x / total).otherwise(1.0 / len(model.classes)))
