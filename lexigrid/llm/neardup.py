"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its runs of five words (all its words if there
are fewer).  A shingle weighs its count times an inverse document frequency
between one half and one: one for shingles in at most ``common`` of the
documents, less beyond.  So document frequencies matter for few shingles, at
most ``1 / common`` times the mean number per document, whatever the corpus is:
a sketch of hashed counts over all documents names the slots that may hold
them, and a second pass counts exactly what falls in these slots.

``samples`` consistent weighted samples (Ioffe, 2010) of each distinct text
form bands of ``rows``.  Texts that share a band are compared by their samples,
blockwise, and tied into candidate groups if at least ``ASSUMED`` of the
samples agree.  Within a group texts are compared by their exact weighted
Jaccard similarity; 0.8 or more is a link.  Texts already linked in a block
need not be compared again, which loses no class, and blocks report a spanning
forest instead of all pairs.  Classes are the connected components.

Copies (equal words) are one text throughout.  Buckets and groups of more than
``BLOCK`` texts are cut into blocks that meet pairwise in separate tasks.

Defined results: texts without words (also null and empty) are copies if they
are equal, with null as empty; repeated rows are copies, all kept or none; an
empty table gives no rows; a row without an id belongs to the class of its
copies, and rows of a class in which none has an id are kept.  Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm import text as T
from lexigrid.llm.components import components
from lexigrid.llm.tables import lookup
from lexigrid.session import staged

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
ASSUMED = 39  # of 64 samples; at a similarity of 0.8 fewer agree once in 10 000 pairs
BLOCK = 1024
SLOT_BITS, KEY_BITS, TABLE_BITS = 20, 44, 16


def shingles(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk: ``(key, count, bounds)``, keys of a document sorted;
    and the digest of the words of each document, two columns."""
    hashes, _, owners = T.runs(points, offsets)
    n = len(offsets) - 1
    bounds = T.spans(owners, n)
    sizes = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros((n, 2), np.uint64)
    place = np.arange(len(hashes)) - bounds[owners]
    runs = hashes.copy()
    whole = np.arange(len(hashes)) + WORDS <= bounds[owners + 1]
    for k in range(1, WORDS):
        later = np.zeros(len(hashes), np.uint64)
        later[: max(0, len(hashes) - k)] = hashes[k:]
        later[np.arange(len(hashes)) + k >= bounds[owners + 1]] = 0
        runs = T.mix(runs * np.uint64(0x9FB21C651E98DF25) + later)
    runs, owner = runs[whole | (place == 0)], owners[whole | (place == 0)]
    packed = (owner.astype(np.uint64) << np.uint64(KEY_BITS)) | (runs >> np.uint64(64 - KEY_BITS))
    keys, counts = np.unique(packed, return_counts=True)
    bounds_of = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
    digest = np.zeros((n, 2), np.uint64)
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0xD1342543DE82EF95)):
        mixed = T.mix(hashes ^ T.mix(place.astype(np.uint64) * np.uint64(salt)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        digest[:, i] = T.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64))
    return keys & np.uint64((1 << KEY_BITS) - 1), counts, bounds_of, digest


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(KEY_BITS - SLOT_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies: below one for the sorted ``keys`` only."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = counts.astype(np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            seen = self.keys[at] == keys
            found[seen] *= self.values[at[seen]]
        return found


class Sampler:
    """Consistent weighted samples; the random numbers of a shingle come from tables by its hash."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.factors = draw.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = 1 << TABLE_BITS
        self.r = draw.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, size)).astype(np.float32)
        self.beta = draw.random(size).astype(np.float32)

    def samples(self, keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``[document, sample]``; equal numbers are equal samples.  Rows of documents without shingles are 0."""
        out = np.zeros((len(bounds) - 1, SAMPLES), np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return out
        starts, low = bounds[full], np.uint64((1 << TABLE_BITS) - 1)
        keys, logs = T.mix(keys), np.log(weights)
        for k, factor in enumerate(self.factors):
            x = keys * factor
            r = self.r[x >> np.uint64(48)]
            beta = self.beta[(x >> np.uint64(32)) & low]
            t = np.floor(logs / r + beta)
            a = self.log_c[(x >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
            out[full, k] = np.minimum.reduceat(a, starts).view(np.uint32)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two ``(sorted keys, weights)``."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    if not len(b[0]):
        return 0.0
    seen = b[0][at] == a[0]
    shared = float(np.minimum(a[1][seen], b[1][at[seen]]).sum(dtype=np.float64))
    return shared / (total - shared) if total else 0.0


def _common(docs: DataFrame, common: float) -> Weights:
    """Weights of the shingles in more than ``common`` of the documents."""
    texts = docs.select("text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, points, offsets in T.chunks(batch.column("text")):
                total += np.bincount(slots_of(shingles(points, offsets)[0]), minlength=1 << SLOT_BITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], names=["s", "n"])

    counted = staged(texts.mapInArrow(sketch, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "slots")
    rows = counted.where("s = -1").first()
    n = rows["n"] if rows else 0
    least = common * n
    # Every slot holds at least its shingle's documents, so at most (all shingles) / least slots are left
    hot = np.array([r["s"] for r in counted.where((F.col("s") >= 0) & (F.col("n") > least)).collect()], np.int64)
    if not len(hot):
        return Weights(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    chosen = np.zeros(1 << SLOT_BITS, bool)
    chosen[hot] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(chosen))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.unpackbits(shared.value).astype(bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for batch in batches:
            for _, points, offsets in T.chunks(batch.column("text")):
                keys = shingles(points, offsets)[0]
                parts.append(np.unique(keys[chosen[slots_of(keys)]], return_counts=True))
                if len(parts) > 16:
                    parts = [_summed(parts)]
        keys, counts = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["k", "n"])

    exact = texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    found = exact.toArrow()
    keys, counts = found["k"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    idf = np.log1p(n / counts[order]) / np.log1p(1 / common)
    return Weights(keys[order], (0.5 + 0.5 * np.minimum(1, idf)).astype(np.float32))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _signed(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, key, sig``: digest of the words and samples of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            texts = batch.column("text")
            for at, points, offsets in T.chunks(texts):
                keys, counts, bounds, digest = shingles(points, offsets)
                found = sampler.samples(keys, shared.value.of(keys, counts), bounds)
                sizes = np.diff(bounds)
                names = [d.tobytes() for d in digest]
                sigs: list[bytes | None] = [s.tobytes() for s in found]
                for i in np.flatnonzero(sizes == 0):
                    names[i] = hashlib.md5((texts[at + int(i)].as_py() or "").encode("utf-8", "surrogatepass")).digest()
                    sigs[i] = None
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sizes)), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "key", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, key binary, sig binary")


def _blocks(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Cut groups of more than ``BLOCK`` rows into blocks and pair them up.

    Adds ``bi <= bj``, the pair, and ``mine``, the block a row belongs to;
    groups of one row are left out.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1")
    sized = rows.join(counts, group).withColumn("_b", F.expr(f"cast((_n + {BLOCK - 1}) div {BLOCK} as int)"))
    mine = F.pmod(F.xxhash64(member, F.lit("block")), F.col("_b")).cast("int")
    pairs = sized.withColumn("mine", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return pairs.withColumns({"bi": F.least("mine", "_o"), "bj": F.greatest("mine", "_o")}).drop("_n", "_b", "_o")


def _by_group(
    rows: DataFrame, group: str, work: Callable[[pa.Table], list[tuple[int, int]]]
) -> DataFrame:
    """Edges that ``work`` finds in each pair of blocks, over sorted partitions."""
    keys = [group, "bi", "bj"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            edges = work(pa.Table.from_batches(held)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(c[a] for c in columns)
                if here != last:
                    if held:
                        yield done()
                    held, last = [], here
                held.append(batch.slice(a, b - a))
        yield done()

    placed = rows.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(walk, "a long, b long")


class _Sets:
    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.of[i], self.of[j]
        self.of[self.of == max(a, b)] = min(a, b)


def _agreeing(sigs: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that agree with text ``i`` in enough samples."""
    return others[(sigs[others] == sigs[i]).sum(1) >= ASSUMED] if len(others) else others


def _forest(table: pa.Table, same: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Spanning links between the texts of a pair of blocks.

    Every two texts whose samples agree are considered; ``same`` decides, if
    given.  Two texts that are linked already are not compared.
    """
    ids = table["rep"].to_numpy()
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, SAMPLES)
    mine = table["mine"].to_numpy()
    cross = table["bi"][0].as_py() != table["bj"][0].as_py()
    left = np.flatnonzero(mine == table["bi"][0].as_py())
    sets, edges = _Sets(len(ids)), []
    # texts of one block are tied where that block meets itself; here only links across are needed
    for i in left:
        others = np.flatnonzero(mine != mine[i]) if cross else np.arange(i + 1, len(ids))
        for j in _agreeing(sigs, i, others[sets.of[others] != sets.of[i]]):
            if sets.of[i] != sets.of[j] and (same is None or same(i, j)):
                sets.join(i, j)
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _verified(weights) -> Callable[[pa.Table], list[tuple[int, int]]]:
    def work(table: pa.Table) -> list[tuple[int, int]]:
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for _, points, offsets in T.chunks(table["text"].combine_chunks()):
            keys, counts, bounds, _ = shingles(points, offsets)
            found = weights.value.of(keys, counts)
            sets += [(keys[a:b], found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return _forest(table, lambda i, j: similarity(sets[i], sets[j]) >= SIMILARITY)

    return work


def _band(k: int) -> Column:
    return F.xxhash64(F.lit(k), F.expr(f"substring(sig, {1 + 4 * ROWS * k}, {4 * ROWS})"))


def classes(docs: DataFrame, common: float = 0.01) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs(doc_id, text)``.

    The class id is the smallest id of the class, and only that row is kept.
    """
    spark = docs.sparkSession
    weights = _common(docs, common)
    shared = spark.sparkContext.broadcast(weights)
    signed = staged(_signed(docs, weights), "signed")
    copies = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"))
    copies = staged(copies, "texts")
    texts = copies.where("sig IS NOT NULL AND rep IS NOT NULL").select("rep", "sig")

    bands = texts.select("rep", "sig", F.explode(F.array(*map(_band, range(BANDS)))).alias("band"))
    alike = _by_group(_blocks(bands, "band", "rep"), "band", lambda t: _forest(t, None))
    groups = staged(components(alike).select(F.col("node").alias("rep"), F.col("root").alias("near")), "groups")

    members = groups.join(texts, "rep").select(F.col("rep").alias("doc_id"), "near", "sig")
    named = lookup(docs.select("doc_id", "text"), groups.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    named = named.join(members.hint("shuffle_hash"), "doc_id").withColumnRenamed("doc_id", "rep")
    named = named.dropDuplicates(["rep"])
    links = _by_group(_blocks(staged(named, "members"), "near", "rep"), "near", _verified(shared))
    near = components(links).select(F.col("node").alias("rep"), F.col("root").alias("_root"))

    whole = copies.select("key", "rep").join(near, "rep", "left")
    named = whole.select("key", F.coalesce("_root", "rep").alias("class_id"))
    out = signed.select("doc_id", "key").join(named, "key").drop("key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))
