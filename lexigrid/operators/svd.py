"""Truncated singular value decomposition of the feature matrix.

Randomised subspace iteration (Halko, Martinsson and Tropp 2011).  The matrix
stays a table of cells and the block of vectors a table with a list for each
row or column of the matrix, whatever its width: a product is a join and a sum
for each place of the list, added up where cells lie before the exchange; these
cells do not go through Python.  Only matrices of a few components squared come to the
driver.

Where the block of the columns is at most ``BLOCK_BYTES``, measured, it is held:
cells are brought to their documents once, as lists, and a step of the iteration
(the transpose times the matrix times the block) reads these rows once and
exchanges one partial sum for each column and task.  Nothing that grows with the
documents is joined, staged or shuffled in a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexigrid.operators import lookup
from lexigrid.operators.lookup import lookup_join
from lexigrid.session import staged

BLOCK_BYTES = 64 << 20
_TOGETHER = 64  # tasks whose inner products are added up in one
_CELLS = 1 << 20  # cells, or numbers of products, that a task works through at a time


@dataclass(frozen=True)
class TruncatedSVD:
    """``loadings`` has ``idx, v``: a list with a number for each component."""

    singular_values: tuple[float, ...]
    loadings: DataFrame


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _as_lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _product(cells: DataFrame, vectors: DataFrame, on: str, out: str, width: int, **join) -> DataFrame:
    """``out, v``: the matrix, or its transpose, times the block of vectors."""
    rows = lookup_join(cells.select(on, out, "value"), vectors, [on], row_bytes=32 + 8 * width, **join)
    value = F.col("value").cast("double")
    sums = [F.sum(value * F.get("v", F.lit(j))).alias(f"_{j}") for j in range(width)]
    return rows.groupBy(out).agg(*sums).select(out, F.array(*[f"_{j}" for j in range(width)]).alias("v"))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Inner products of the vectors of the block with each other."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            v = _lists(batch.column("v"), width)
            total += v.T @ v
        group = TaskContext.get().partitionId() // _TOGETHER
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total.tobytes()], pa.binary())], names=["g", "m"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [sum(np.frombuffer(m) for m in group["m"]).tobytes()]})

    parts = vectors.select("v").mapInArrow(products, "g long, m binary").groupBy("g").applyInPandas(add, "m binary")
    return sum((np.frombuffer(r["m"]) for r in parts.collect()), np.zeros(width * width)).reshape(width, width)


def _rotated(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """The block of vectors times a small matrix."""
    width = by.shape[0]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), _as_lists(_lists(batch.column("v"), width) @ by)], names=[key, "v"])

    return vectors.select(key, "v").mapInArrow(turn, f"`{key}` {vectors.schema[key].dataType.simpleString()}, v array<double>")


def _basis(gram: np.ndarray) -> np.ndarray:
    """Turns vectors with these inner products into an orthonormal basis of what they span."""
    values, rotation = np.linalg.eigh(gram)
    used = values > 1e-12 * values.max()
    return rotation[:, used] / np.sqrt(values[used])


def _orthonormal(vectors: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of what the vectors span."""
    basis = _basis(_gram(vectors, width))
    return staged(_rotated(vectors, key, basis), "svd"), basis.shape[1]


def _by_document(docs: pa.Array, at: np.ndarray, value: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Cells as one row for each document: its id and the lists of its columns and values."""
    coded = docs.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (at, value)]
    yield pa.RecordBatch.from_arrays([coded.dictionary, *lists], names=names)


def _rows(cells: DataFrame, columns: np.ndarray) -> DataFrame:
    """``doc_id, at, value``: a row for each document, with the places of its columns in ``columns`` and its values.

    Cells that lie together are listed before the exchange, so a document moves once for each task that has a part of it.
    """
    shared = cells.sparkSession.sparkContext.broadcast(columns)
    names = ["doc_id", "at", "value"]
    fields = f"doc_id {cells.schema['doc_id'].dataType.simpleString()}, at array<int>, value array<double>"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            at = np.searchsorted(shared.value, table["idx"].to_numpy()).astype(np.int32)
            return _by_document(table["doc_id"].combine_chunks(), at, table["value"].to_numpy(), names)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _CELLS:
                yield from run(held)
                held, n = [], 0
        if n:
            yield from run(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a partition of about ``lookup.JOIN_BYTES``
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            docs, at, value = (table[c].combine_chunks() for c in names)
            owner = pa.array(np.repeat(np.arange(len(docs)), at.value_lengths().to_numpy()))
            yield from _by_document(docs.take(owner), at.flatten().to_numpy(), value.flatten().to_numpy(), names)

    whole = cells.where("idx IS NOT NULL AND value IS NOT NULL").select("doc_id", "idx", F.col("value").cast("double").alias("value"))
    parts = max(1, -(-12 * whole.count() // lookup.JOIN_BYTES))
    return staged(whole.mapInArrow(listed, fields).repartition(parts, "doc_id").mapInArrow(merged, fields), "rows")


def _there_and_back(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The transpose of the matrix times the matrix times the block."""
    size, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)
    names = [f"_{j}" for j in range(width)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, seen = shared.value, np.zeros((width, size)), np.zeros(size, bool)
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("at").value_lengths().to_numpy())])
            every, values = (batch.column(c).flatten().to_numpy() for c in ("at", "value"))
            first = 0
            while first < batch.num_rows:  # runs of documents
                to = max(first + 1, int(np.searchsorted(ends, ends[first] + _CELLS // width, "right")) - 1)
                run = slice(ends[first], ends[to])
                at, value, bounds = every[run], values[run], ends[first : to + 1] - ends[first]
                seen[at] = True
                sizes = np.diff(bounds)
                for j in range(width):
                    left = np.add.reduceat(block[at, j] * value, bounds[:-1])
                    total[j] += np.bincount(at, np.repeat(left, sizes) * value, size)
                first = to
        (found,) = np.nonzero(seen)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(t[found]) for t in total]], names=["at", *names])

    parts = rows.select("at", "value").mapInArrow(products, ", ".join(["at long", *[f"{n} double" for n in names]]))
    sums = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((size, width))
    out[sums["at"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], 1)
    return out


def _fit_held(cells: DataFrame, vectors: DataFrame, k: int, width: int, iterations: int) -> TruncatedSVD:
    """``fit`` with the block of vectors held by the driver and every task."""
    table = vectors.where("idx IS NOT NULL").orderBy("idx").toArrow()
    columns, block = table["idx"].to_numpy(), _lists(table["v"].combine_chunks(), width)
    rows = _rows(cells, columns)
    keyed = rows.where("doc_id IS NOT NULL")
    for _ in range(iterations):
        right = _there_and_back(keyed, block)
        block = np.ascontiguousarray(right @ _basis(right.T @ right))
    values, rotation = np.linalg.eigh(block.T @ _there_and_back(rows, block))
    top = np.argsort(-values, kind="stable")[: min(k, block.shape[1])]
    singular = np.sqrt(np.maximum(values[top], 0.0))
    found = pa.table({"idx": table["idx"], "v": _as_lists(block @ rotation[:, top])})
    loadings = cells.sparkSession.createDataFrame(found)
    return TruncatedSVD(tuple(map(float, singular)), staged(loadings, "svd", vectors.schema))


def fit(cells: DataFrame, k: int, iterations: int = 5, oversample: int = 8, seed: int = 42, **join) -> TruncatedSVD:
    """The top ``k`` components of ``doc_id, idx, value``; rows are not centred."""
    cells = cells.select("doc_id", "idx", "value")
    width = k + oversample
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.xxhash64("idx", j, F.lit(seed)).cast("double") / float(1 << 63)
    )
    vectors = staged(cells.select("idx").distinct().select("idx", draw.alias("v")), "svd")
    if 0 < lookup.bytes_of(vectors) <= min(BLOCK_BYTES, join.get("broadcast_bytes", lookup.BROADCAST_BYTES)):
        return _fit_held(cells, vectors, k, width, iterations)
    for _ in range(iterations):
        left = staged(_product(cells, vectors, "idx", "doc_id", width, **join), "svd")
        right = staged(_product(cells, left, "doc_id", "idx", width, **join), "svd")
        vectors, width = _orthonormal(right, "idx", width)
    left = staged(_product(cells, vectors, "idx", "doc_id", width, **join), "svd")
    values, rotation = np.linalg.eigh(_gram(left, width))
    top = np.argsort(-values, kind="stable")[: min(k, width)]
    singular = np.sqrt(np.maximum(values[top], 0.0))
    return TruncatedSVD(tuple(map(float, singular)), staged(_rotated(vectors, "idx", rotation[:, top]), "svd"))


def project(cells: DataFrame, model: TruncatedSVD, keep=(), **join) -> DataFrame:
    """``doc_id, *keep, v0, v1, ..``: documents in the reduced space."""
    width = len(model.singular_values)
    found = _product(cells, model.loadings, "idx", "doc_id", width, **join)
    if keep:
        found = cells.select("doc_id", *keep).distinct().join(found, "doc_id")
    return found.select("doc_id", *keep, *[F.get("v", F.lit(j)).alias(f"v{j}") for j in range(width)])
