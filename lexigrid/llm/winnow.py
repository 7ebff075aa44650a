"""Benchmark decontamination by winnowed k-gram fingerprints.

Words are runs of ``a-z``, digits and characters beyond ASCII, after ``A-Z``
became lower case.  A benchmark item is the set of its windows of ``SPAN``
words; an item of fewer words is one window.  Of the k-grams of ``GRAM`` words
in a window the one with the least hash is its fingerprint, so neighbouring
windows mostly share it, and two texts that share a window share its
fingerprint: no shared span of ``SPAN`` words can be missed.  (A window of fewer
words is its own fingerprint, so for each such length every gram is kept.)

1. Benchmark texts give windows: fingerprint, number of words, two 64-bit
   hashes of all words.  A bitmap of fixed size tells which fingerprints occur.
2. Documents are read once, in place.  A fingerprint in the bitmap is extended
   to the windows that chose it; these, some of them false, go on as
   candidates.  Documents without candidates leave two numbers.
3. Candidates meet the distinct windows by both hashes, whatever the length of
   the span: neighbouring windows overlap, and their union are the hit words.
4. Distinct windows by document lead to the items that hold them.

Nothing grows on the driver or in a broadcast but the bitmap, which is of fixed
size; the join sides are broadcast by measured bytes and shuffled beyond that.
Distinct windows take part in the join, not their occurrences in items, so an
item or passage that is everywhere makes no pairs.

Defined results: null and empty text has no words; an item without words has no
window; items of equal id are one; a window of an item without id makes hits but
counts for no item; repeated rows of documents are each a result row; empty
tables give no rows or no hits.  Only the named columns are read, whatever
others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm import raw, text as T
from lexigrid.operators.lookup import lookup_join
from lexigrid.session import staged

SPAN, GRAM = 10, 5
SLOT_BITS = 24  # of the bitmap: 2 MB
_ROW_BITS = 40
_STEP = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_IS_WORD[0x80:] = True

_CANDIDATE = pa.struct([("words", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int64())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw.words(raw.LOWER[data], offsets, _IS_WORD)


def grams(hashes: np.ndarray, starts: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each of ``starts``."""
    found = hashes[starts] ^ np.uint64(n)
    for k in range(1, n):
        found = T.mix(found * _STEP[salt] + hashes[starts + k])
    return T.mix(found + np.uint64(salt + 1))


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of ``n`` words inside one document."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.arange(max(0, len(ends) - n + 1))
    return starts[starts + n <= ends[: len(starts)]]


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least gram hash of each window of ``SPAN`` words."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    each = grams(hashes, np.arange(len(hashes) - GRAM + 1), GRAM)
    least = each[starts]
    for k in range(1, SPAN - GRAM + 1):
        np.minimum(least, each[starts + k], out=least)
    return least


def slots_of(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def windows(items: DataFrame, id: str, text: str) -> DataFrame:
    """``item_id, words, h1, h2, print`` for every distinct window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in raw.chunks(batch.column("text")):
                hashes, bounds = words(data, offsets)
                sizes = np.diff(bounds)
                for n in np.unique(np.minimum(sizes[sizes > 0], SPAN)).tolist():
                    starts = window_starts(bounds, n)
                    owners = np.searchsorted(bounds, starts, "right") - 1
                    if n < SPAN:
                        starts, owners = starts[sizes[owners] == n], owners[sizes[owners] == n]
                    first = grams(hashes, starts, n)
                    prints = fingerprints(hashes, starts) if n == SPAN else first
                    columns = [
                        batch.column("item_id").take(pa.array(at + owners)),
                        pa.array(np.full(len(starts), n, np.int32)),
                        _signed(first), _signed(grams(hashes, starts, n, 1)), _signed(prints),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "h1", "h2", "print"])

    read = items.select(F.col(id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return read.mapInArrow(cut, "item_id string, words int, h1 long, h2 long, print long").distinct()


def bitmap(prints: DataFrame) -> np.ndarray:
    """Which slots fingerprints fall in; the table collected has at most ``2 ** SLOT_BITS / 64`` rows."""
    slot = F.shiftrightunsigned("print", 64 - SLOT_BITS)
    word, bit = F.shiftright(slot, 6).cast("int"), F.pmod(slot, F.lit(64)).cast("int")
    found = prints.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    table = found.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def candidates(docs: DataFrame, known: np.ndarray, short: list[int], id: str, text: str) -> DataFrame:
    """``row, doc_id, n_words, found`` for every document: windows whose fingerprint is in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known))
    schema = "row long, doc_id {}, n_words long, found array<struct<words:int,h1:bigint,h2:bigint,start:bigint>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        row = TaskContext.get().partitionId() << _ROW_BITS
        for batch in batches:
            for at, data, offsets in raw.chunks(batch.column("text")):
                hashes, bounds = words(data, offsets)
                n = len(offsets) - 1
                parts = []
                for length in [*short, SPAN]:
                    starts = window_starts(bounds, length)
                    prints = fingerprints(hashes, starts) if length == SPAN else grams(hashes, starts, length)
                    chosen = starts[known[slots_of(prints)]]
                    parts.append((np.full(len(chosen), length, np.int32), chosen))
                lengths, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(starts, kind="stable")
                lengths, starts = lengths[order], starts[order]
                h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
                for length in np.unique(lengths).tolist():
                    mine = lengths == length
                    h1[mine], h2[mine] = grams(hashes, starts[mine], length), grams(hashes, starts[mine], length, 1)
                owners = np.searchsorted(bounds, starts, "right") - 1
                fields = [pa.array(lengths), _signed(h1), _signed(h2), pa.array(starts - bounds[owners])]
                found = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(fields, fields=list(_CANDIDATE)),
                )
                rows = pa.array(row + np.arange(n, dtype=np.int64))
                row += n
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column("doc_id").slice(at, n), pa.array(np.diff(bounds)), found],
                    names=["row", "doc_id", "n_words", "found"],
                )

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    out = staged(read.mapInArrow(search, schema.format(read.schema["doc_id"].dataType.simpleString())), "candidates")
    shared.destroy()
    return out


def _covered(spans: Column) -> Column:
    """Number of words in the union of ``(start, words)`` spans, sorted by start."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, span: Column) -> Column:
        end = span["start"] + span["words"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["upto"], span["start"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(spans, none, add, lambda acc: acc["n"])


def contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every row of ``docs``: the words in windows of ``items``, and their sorted ids."""
    key = ["words", "h1", "h2"]
    held = staged(windows(items, item_id, item_text), "windows")
    short = sorted(r["words"] for r in held.where(F.col("words") < SPAN).select("words").distinct().collect())
    read = candidates(docs, bitmap(held), short, id, text)
    hits = staged(lookup_join(read.select("row", F.inline("found")), held.select(*key).distinct(), key, row_bytes=40), "hits")
    span = F.struct("start", "words")
    words_hit = hits.groupBy("row").agg(_covered(F.array_sort(F.collect_list(span))).alias("n_hit"))
    owned = held.where("item_id IS NOT NULL").select(*key, "item_id")
    of_window = owned.groupBy(*key).agg(F.collect_set("item_id").alias("_items"))
    named = lookup_join(hits.select("row", *key).distinct(), of_window, key).select("row", F.explode("_items").alias("_item"))
    items_hit = named.groupBy("row").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    found = staged(words_hit.join(items_hit, "row", "left"), "found")
    return lookup_join(read.drop("found"), found, ["row"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
