"""Quality classifier: hashed word n-grams, logistic regression, follow the regularised leader.

Features are single tokens and pairs of neighbouring tokens (words in lower
case, and runs of other marks), hashed to ``2 ** bits`` weights; a feature
counts ``1 / sqrt(n)`` for each occurrence among ``n``.  A token that follows
itself gives one and the same pair whatever the token is.  The weights are
trained by FTRL-proximal, which keeps most of them at exactly zero, and a text
is scored by one sparse dot product.

Training reads a sample of at most ``max_rows`` labelled rows (the rows with
the lowest hash of their id, whatever the data is), dealt to ``shards`` groups
by that hash; each is trained on its own and the weights are averaged.
Scoring reads every text where it lies; nothing is shuffled but the sample.

Defined results: null text counts as empty; an empty text scores the bias
alone; a null label is not learned from; repeated rows score alike; with no
labelled row at all every score is 0.5; columns other than the named ones are
not read and pass through ``score`` unchanged, but for one of the name of the
result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm import text as T


_TWICE = T.mix(np.array([2], np.uint64))[0]


@dataclass(frozen=True)
class FtrlModel:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for at, points, offsets in T.chunks(texts):
            n = len(offsets) - 1
            slots, bounds = slots_of(points, offsets, self.bits)
            many = np.maximum(1, bounds[1:] - bounds[:-1])
            z = T.sums(self.weights[slots], bounds) / np.sqrt(many) + self.bias
            out[at : at + n] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def slots_of(points: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of a chunk, those of a document together, and their bounds."""
    hashes, _, owners = T.runs(points, offsets, marks=True)
    slots = np.empty(2 * len(hashes), np.int64)
    shift = np.uint64(64 - bits)
    slots[0::2] = hashes >> shift
    before = np.roll(hashes, 1)
    if len(hashes):
        first = np.r_[True, owners[1:] != owners[:-1]]
        before[first] = 0
    pairs = T.mix(before * np.uint64(0xD6E8FEB86659FD93) + hashes)
    pairs[before == hashes] = _TWICE
    slots[1::2] = pairs >> shift
    return slots, 2 * T.spans(owners, len(offsets) - 1)


def ftrl(
    rows: Iterable[tuple[np.ndarray, float]],
    bits: int,
    epochs: int,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
) -> np.ndarray:
    """Weights, the bias last, after ``epochs`` passes over ``(slots, label)`` rows in order.

    Rows are taken one by one and kept end to end in three buffers: arrays for
    each row would stay with the Python worker as gaps in its memory.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    kept, times, spans = bytearray(), bytearray(), []
    for slots, label in rows:
        index, counts = np.unique(slots, return_counts=True)
        first = len(kept) // 4
        kept += index.astype(np.int32).tobytes()
        times += counts.astype(np.int32).tobytes()
        spans.append((first, first + len(index), np.sqrt(max(1, len(slots))), label))
    indices, counted = np.frombuffer(kept, np.int32), np.frombuffer(times, np.int32)

    def at(i: np.ndarray) -> np.ndarray:
        lead = np.sign(z[i]) * l1 - z[i]
        return np.where(np.abs(z[i]) <= l1, 0.0, lead / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for a, b, length, label in spans:
            i, x = np.append(indices[a:b], size - 1), np.append(counted[a:b] / length, 1.0)
            w = at(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return at(np.arange(size))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    bits: int = 18,
    max_rows: int = 20_000,
    shards: int = 4,
    epochs: int = 3,
) -> FtrlModel:
    """Train on the labelled ids of ``labels(doc_id, <label>)``, at most ``max_rows`` of them."""
    order = F.xxhash64(F.col("doc_id"), F.lit("quality sample")).bitwiseAND(F.lit((1 << 62) - 1))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("double").alias("_y"), order.alias("_o")
    )
    count = known.count()
    # 5 % below the bound, so that the number of rows under the cut stays within it
    cut = (1 << 62) if count <= max_rows else int((1 << 62) * (0.95 * max_rows / count))
    sample = known.where(F.col("_o") < cut).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_o", "text"], kind="stable", na_position="first")

        def rows() -> Iterator[tuple[np.ndarray, float]]:
            for at, points, offsets in T.chunks(pa.array(group["text"], pa.string(), from_pandas=True)):
                slots, bounds = slots_of(points, offsets, bits)
                ys = group["_y"].to_numpy()[at : at + len(offsets) - 1]
                yield from ((slots[a:b], y) for a, b, y in zip(bounds[:-1], bounds[1:], ys, strict=True))

        found = ftrl(rows(), bits, epochs).astype(np.float32)
        return pd.DataFrame({"n": [len(group)], "w": [found.tobytes()]})

    trained = (
        rows.withColumn("_s", F.col("_o") % shards).groupBy("_s").applyInPandas(train, "n long, w binary").collect()
    )
    total = np.zeros((1 << bits) + 1)
    for r in trained:
        total += r["n"] * np.frombuffer(r["w"], np.float32)
    total /= max(1, sum(r["n"] for r in trained))
    return FtrlModel(total[:-1].astype(np.float32), float(total[-1]), bits)


def score(docs: DataFrame, model: FtrlModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as a further column."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(shared.value.scores(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rated, f"{fields}, `{name}` double")
