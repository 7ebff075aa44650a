"""Near-duplicate vectors: product quantisation over coarse inverted lists.

Equal vectors are one point with a count.  A coarse quantiser of unit vectors
names a home list for every point; what is left of it after its centroid is
coded in ``PARTS`` subspaces of up to 256 words each.  Every point is a query
in its ``probes`` nearest lists.  There a table of distances from the query to
each word gives, by one look-up for each subspace, its distance to the coded
points.  As the coding error of each point is stored, a point can only be
within reach if that distance less its error is; all that pass are compared by
exact cosine in double precision.

A pair is met where one is at home and the other probes; if both lists meet it,
each side counts its own half, else the one that was found counts for both, so
links are symmetric.  Lists of more than ``LIST`` points and ``QUERIES``
queries are cut into blocks.  A block reports counts and a spanning forest of
the links it saw, never pairs; components follow from the forests.

The quantisers are fitted on a sample of at most ``max_sample`` points (those
with the lowest hash); lists number one for every ``per_list`` points up to
``max_lists``.  Every point is indexed.

Vectors of each length are indexed by themselves, one length after another; a
table is expected to have few.

Defined results: null or zero vectors and those with null or non-finite
components link with nothing; vectors of different lengths do not link;
vectors that differ by a factor are linked as cosine 1; an empty table gives no
rows; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm.components import components
from lexigrid.session import staged

PARTS, CODES = 8, 256
LIST, QUERIES = 1024, 8192


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 4096):
        d = (centres**2).sum(1) - 2 * x[a : a + 4096] @ centres.T
        if k == 1:
            out[a : a + 4096, 0] = d.argmin(1)
        else:
            near = np.argpartition(d, k - 1, 1)[:, :k] if k < d.shape[1] else np.tile(np.arange(k), (len(d), 1))
            order = np.lexsort((near, np.take_along_axis(d, near, 1)), axis=1)
            out[a : a + 4096] = np.take_along_axis(near, order, 1)
    return out


def k_means(x: np.ndarray, k: int, steps: int = 8, seed: int = 3) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``."""
    draw = np.random.default_rng(seed)
    centres = x[np.sort(draw.permutation(len(x))[:k])].copy()
    for _ in range(steps):
        own = _nearest(x, centres)[:, 0]
        counts = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        full = counts > 0
        centres[full] = total[full] / counts[full, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    lists: np.ndarray  # [list, dimension]
    words: np.ndarray  # [part, word, dimension of a part]

    def homes(self, x: np.ndarray, probes: int) -> np.ndarray:
        return _nearest(x, self.lists, min(probes, len(self.lists)))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """``[part, row, dimension of a part]``, filled up with zeros."""
        width = self.words.shape[2]
        full = np.zeros((len(x), PARTS * width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), PARTS, width).transpose(1, 0, 2)

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each residual, and the length of what they miss."""
        parts = self.parts(rest)
        codes = np.stack([_nearest(p, w)[:, 0] for p, w in zip(parts, self.words, strict=True)], 1)
        missed = sum(((p - w[c]) ** 2).sum(1) for p, w, c in zip(parts, self.words, codes.T, strict=True))
        return codes, np.sqrt(missed)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances ``[query, coded point]`` by table look-up."""
        total = np.zeros((len(rest), len(codes)))
        for p, w, c in zip(self.parts(rest), self.words, codes.T, strict=True):
            table = (p**2).sum(1)[:, None] + (w**2).sum(1) - 2 * p @ w.T
            total += table[:, c]
        return total


def fit(sample: np.ndarray, lists: int) -> Quantiser:
    """Coarse and residual codes from unit vectors."""
    centres = k_means(sample, lists)
    rest = sample - centres[_nearest(sample, centres)[:, 0]]
    width = -(-sample.shape[1] // PARTS)
    blank = Quantiser(centres, np.zeros((PARTS, 1, width)))
    return Quantiser(centres, np.stack([k_means(p, CODES) for p in blank.parts(rest)]))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow or pandas column of equally long lists."""
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)
    return np.stack(column.to_numpy())


def _block(quantiser: Quantiser, rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one block of a list: ``a, b, n``; ``b`` null for counts, ``n`` null for links."""
    here = int(rows["cell"].iloc[0])
    ids, counts = rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    x = _unit(_matrix(rows["v"]))
    homes = _matrix(rows["cells"])
    listed, asking = np.flatnonzero(rows["listed"].to_numpy()), np.flatnonzero(~rows["listed"].to_numpy())
    if not len(listed) or not len(asking):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "Int64"})
    rest = x - quantiser.lists[here]
    codes, missed = quantiser.codes(rest[listed])
    reach = (np.sqrt(2 - 2 * least) + missed + 1e-6) ** 2
    added = np.zeros(len(rows))
    tie = np.arange(len(rows))  # forest over the rows; a row stands for its id
    linked = np.zeros(len(rows), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(asking), 512):
        q = asking[a : a + 512]
        near = quantiser.distances(rest[q], codes) <= reach
        i, j = np.nonzero(near)
        if len(i) * 8 > near.size:
            near &= x[q] @ x[listed].T >= least
        else:
            near[i, j] = np.einsum("ij,ij->i", x[q[i]], x[listed[j]]) >= least
        near &= ids[q][:, None] != ids[listed]
        if not near.any():
            continue
        added[q] += near @ counts[listed]
        for home in np.unique(homes[q, 0]):
            if home == here:
                continue
            own = homes[q, 0] == home
            alone = near[own] & ~(homes[listed] == home).any(1)
            added[listed] += counts[q[own]] @ alone
        found.append((q, np.packbits(near, axis=1)))
        linked[q] |= near.any(1)
        linked[listed] |= near.any(0)
    changed = bool(found)
    while changed:
        was = tie.copy()
        for q, bits in found:
            near = np.unpackbits(bits, axis=1, count=len(listed)).astype(bool)
            low = np.where(near, tie[listed], len(rows)).min(1)
            tie[q] = np.minimum(tie[q], low)
            tie[listed] = np.minimum(tie[listed], np.where(near, tie[q][:, None], len(rows)).min(0))
        tie = tie[tie]
        changed = not np.array_equal(was, tie)
    counted = np.flatnonzero(added)
    tied = np.flatnonzero(linked & (ids != ids[tie]))
    return pd.DataFrame(
        {
            "a": np.concatenate([ids[counted], ids[tied]]),
            "b": pd.array([None] * len(counted) + list(ids[tie[tied]]), "Int64"),
            "n": pd.array(list(added[counted].astype(np.int64)) + [None] * len(tied), "Int64"),
        }
    )


def near_vectors(
    vectors: DataFrame,
    least: float = 0.9,
    probes: int = 16,
    per_list: int = 256,
    max_lists: int = 4096,
    max_sample: int = 1 << 16,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    v = F.col("embedding").cast("array<double>")
    good = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    usable = vectors.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), F.transform(v, lambda x: x + 0.0)).alias("v"))
    usable = usable.withColumn("d", F.size("v"))
    lengths = [r["d"] for r in usable.where("v IS NOT NULL").select("d").distinct().orderBy("d").collect()]
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    lone = usable.where("v IS NULL")
    parts = [lone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))]
    for d in lengths:
        same = usable.where("v IS NOT NULL").where(F.col("d") == d).drop("d")
        parts.append(_of_one_length(same, kind, least, probes, per_list, max_lists, max_sample))
    found = reduce(lambda a, b: a.unionByName(b), parts)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _of_one_length(
    usable: DataFrame, kind: str, least: float, probes: int, per_list: int, max_lists: int, max_sample: int
) -> DataFrame:
    """``vec_id, n_links, component_id`` of vectors ``v`` of one length, none of them zero."""
    spark = usable.sparkSession
    points = usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    points = staged(points, "points")
    n = points.count()
    lists = int(np.clip(n // per_list, 1, max_lists))
    order = F.xxhash64("id", F.lit("sample")).bitwiseAND(F.lit((1 << 62) - 1))
    wanted = min(max_sample, max(4096, 32 * lists))
    cut = 1 << 62 if n <= wanted else int((1 << 62) * (0.95 * wanted / n))
    sample = points.where(order < cut).select("id", "v").toArrow().sort_by("id")
    quantiser = fit(_unit(_matrix(sample["v"].combine_chunks())), lists)
    shared = spark.sparkContext.broadcast(quantiser)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                cells = shared.value.homes(_unit(_matrix(part.column("v"))), probes)
                flat = pa.array(cells.ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1], flat)],
                    names=[*part.schema.names, "cells"],
                )

    placed = points.select("id", "n", F.col("v").cast(kind)).mapInArrow(place, f"id long, n long, v {kind}, cells array<int>")
    placed = staged(placed, "placed")
    asked = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asking"))
    homes = placed.groupBy(F.get("cells", F.lit(0)).alias("cell")).agg(F.count("*").alias("held"))
    sizes = asked.join(homes, "cell").select(  # a row for each list
        "cell",
        F.expr(f"cast((held + {LIST - 1}) div {LIST} as int)").alias("lb"),
        F.expr(f"cast((asking + {QUERIES - 1}) div {QUERIES} as int)").alias("qb"),
    )

    def blocks(b: str):
        return F.pmod(F.xxhash64("id", F.lit("block")), F.col(b)).cast("int")

    def all_of(b: str):
        return F.explode(F.sequence(F.lit(0), F.col(b) - 1))

    columns = ["cell", "id", "n", "v", "cells", "listed"]
    queries = placed.withColumn("cell", F.explode("cells")).withColumn("listed", F.lit(False))
    held = placed.withColumn("cell", F.get("cells", F.lit(0))).withColumn("listed", F.lit(True))
    queries = queries.join(F.broadcast(sizes), "cell").select(*columns, blocks("qb").alias("i"), all_of("lb").alias("j"))
    held = held.join(F.broadcast(sizes), "cell").select(*columns, all_of("qb").alias("i"), blocks("lb").alias("j"))
    found = (
        queries.unionByName(held)
        .groupBy("cell", "i", "j")
        .applyInPandas(lambda rows: _block(shared.value, rows, least), "a long, b long, n long")
    )
    found = staged(found, "found")
    links = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    about = (
        points.join(links, "id", "left")
        .join(roots, "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("root", "id").alias("_root"))
    )
    return usable.join(about, "v").select("vec_id", F.col("_links").alias("n_links"), F.col("_root").alias("component_id"))
