"""Filter interaction audit by a stream that takes back what it said too early.

Five filters mark documents: ``A`` to ``D`` look at one text, ``E`` fails every
document whose text a document with a smaller id has as well.  The report says,
for every part (source), every order of the filters and every step, what that
step removes, what earlier steps had removed already, and what it costs.

All of that follows from one small table: how many documents of a part fail
exactly this set of filters.  The files of the table are read once, as a
Structured Streaming query that ends when all are read (``availableNow``):

1. Every document becomes a narrow row: key (SHA-256 of the text), id, part and
   flags (a bit for each of A to D, and for each label).
2. Each task first settles what it can alone.  A document is a copy for good as
   soon as one smaller id is known, so of each text only the rows with the least
   id in the task go on; the others are counted.  A text that a third of all
   rows share is one row for each task.
3. The state of a text is its least id so far, with the parts and flags of the
   rows that have it.  When a smaller id arrives, in whichever file, these rows
   are taken back (-1 as original, +1 as copy) and the newcomer takes their
   place.  States lie in pages of some ``PAGE_ROWS`` texts by hash, so a call
   handles many texts at once and a page stays small whatever the table is.
4. The changes go to a file sink, each exactly once; their sums are the counts.

Lost executors: offsets, state and sink are in the shared folder, and a task
that runs again gives the same rows.  Nothing is collected.  The state, some 60
bytes for each distinct text, is spread evenly over the shuffle partitions and
kept where the session keeps states
(``spark.sql.streaming.stateStore.providerClass``): in memory by default, in
RocksDB for tables whose states are more than the executors' memory.

Defined results: null text is empty; a null part is the empty string; a row
without an id never has a smaller copy and is none to others; rows of equal id
and text are no copies of each other; label rows of one id count together (a
label is set if one row sets it), those without an id not at all; an empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexigrid.llm.tables import lookup
from lexigrid.session import new_path, staged

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
COPY, GOOD, TOXIC = 1 << 4, 1 << 5, 1 << 6
MASK = (1 << 5) - 1
PAGE_ROWS = 1024
RUN_ROWS = 1 << 18

_ROW = "page long, key binary, id long, part string, flags int, n long"
_CHANGE = "part string, flags int, n long"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.char_length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def _flag(condition: Column, bit: int) -> Column:
    return F.when(condition, bit).otherwise(0)


def narrow(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """``doc_id, part, key, mask`` of every document."""
    docs = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    mask = sum(_flag(failed, 1 << LETTERS.index(letter)) for letter, failed in failures(F.col("text")).items())
    return docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask.cast("int").alias("mask"))


def _settled(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows with the least id of their text, summed, and counts of all the others as copies."""
    least = rows.groupby("key", sort=False)["id"].transform("min")
    first = rows["id"] == least
    held = rows[first].groupby(["key", "id", "part", "flags"], sort=False, as_index=False)["n"].sum()
    copies = rows[~first].assign(flags=rows["flags"] | COPY)
    return held, copies.groupby(["part", "flags"], sort=False, as_index=False)["n"].sum()


def first_of_each(rows: DataFrame, pages: int) -> DataFrame:
    """What a task can say by itself: rows with the least id of their text here, and counts (without a key) of the rest."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            frame = pa.Table.from_batches(held).to_pandas()
            no_id = frame["id"].isna()
            known = frame[~no_id].astype({"id": "int64"}).assign(n=1)
            first, copies = _settled(known)
            alone = frame[no_id].assign(n=1).groupby(["part", "flags"], sort=False, as_index=False)["n"].sum()
            first["page"] = [int.from_bytes(k[:7], "big") % pages for k in first["key"]]
            counts = pd.concat([copies, alone], ignore_index=True)
            counts["page"] = [int.from_bytes(str(p).encode()[:6], "big") % pages for p in counts["part"]]
            counts["key"], counts["id"] = None, None
            schema = pa.schema([("page", pa.int64()), ("key", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("flags", pa.int32()), ("n", pa.int64())])
            for out in (first, counts):
                yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield from done()
                held = []
        if held:
            yield from done()

    return rows.mapInArrow(walk, _ROW)


def _packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(held[["key", "id", "part", "flags", "n"]], preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _retracted(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counts, given a page's texts so far and new rows; the page is brought up to date."""
    rows = pd.concat(list(frames), ignore_index=True)
    counts = rows[rows["key"].isna()][["part", "flags", "n"]]
    new = rows[rows["key"].notna()][["key", "id", "part", "flags", "n"]].astype({"id": "int64"}).assign(old=False)
    old = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else new.iloc[:0]
    both = pd.concat([old.assign(old=True), new], ignore_index=True)
    first = both["id"] == both.groupby("key", sort=False)["id"].transform("min")
    held = both[first].groupby(["key", "id", "part", "flags"], sort=False, as_index=False)["n"].sum()
    said = both[first & ~both["old"]][["part", "flags", "n"]]
    late = both[~first][["part", "flags", "n"]].assign(flags=lambda r: r["flags"] | COPY)
    back = both[~first & both["old"]][["part", "flags", "n"]].assign(n=lambda r: -r["n"])
    state.update((_packed(held),))
    changes = pd.concat([counts, said, late, back]).groupby(["part", "flags"], sort=False, as_index=False)["n"].sum()
    yield changes[changes["n"] != 0].astype({"flags": "int32"})


def _stream(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """The files of a Parquet table as a stream of about ``batches`` micro-batches."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-len(files) // batches) or 1)
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == name:  # a file, which streams read by its folder
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def counted(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    part: str = "source",
    batches: int = 4,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """``part, flags, n``: documents by part and set of failed filters and labels, read from the Parquet table at ``path``."""
    pages = max(1, spark.read.parquet(path).count() // page_rows)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(_flag(F.col("quality") == 1, GOOD)).alias("_good"), F.max(_flag(F.col("toxic") == 1, TOXIC)).alias("_toxic")
    )
    rows = lookup(narrow(_stream(spark, path, batches), id, text, part), staged(marks, "labels"), "doc_id", "left")
    flags = F.col("mask") + F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))
    rows = rows.select("key", F.col("doc_id").alias("id"), "part", flags.alias("flags"))
    changes = first_of_each(rows, pages).groupBy("page").applyInPandasWithState(
        _retracted, _CHANGE, "held binary", "append", GroupStateTimeout.NoTimeout
    )
    out = new_path(spark, "changes")
    query = (
        changes.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", new_path(spark, "audit"))
        .format("parquet")
        .start(out)
    )
    query.awaitTermination()
    found = spark.read.schema(_CHANGE).parquet(out).groupBy("part", "flags").agg(F.sum("n").alias("n"))
    return staged(found.where("n <> 0"), "counts")


def _bits(letters: Column) -> Column:
    return sum(_flag(letters.contains(x), 1 << i) for i, x in enumerate(LETTERS))


def report(counts: DataFrame) -> DataFrame:
    """The audit of ``part, flags, n`` by part, order of the filters and step."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("flags", "n")).alias("_counts"))
    steps = parts.select("part", "_counts", F.explode(F.lit(ORDERS)).alias("filter_order")).select(
        "*", F.explode(F.lit(list(range(1, 6)))).alias("step")
    )
    place = F.col("step").cast("int")
    steps = steps.withColumns({
        "_mine": _bits(F.substring("filter_order", place, F.lit(1))),
        "_earlier": _bits(F.substring("filter_order", F.lit(1), place - 1)),
    })

    def total(condition, value=lambda c: c["n"]) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("_counts", zero, lambda acc, c: acc + F.when(condition(c["flags"]), value(c)).otherwise(zero))

    mine, earlier = F.col("_mine"), F.col("_earlier")
    fails, gone = lambda f: f.bitwiseAND(mine) != 0, lambda f: f.bitwiseAND(earlier) != 0
    removed = lambda f: fails(f) & ~gone(f)
    # of the orders of all filters, a filter comes first among those a document fails in one of as many as it fails
    orders = lambda c: (c["n"] * F.lit(len(ORDERS)) / F.bit_count(c["flags"].bitwiseAND(F.lit(MASK)))).cast("long")
    return steps.select(
        "part",
        "filter_order",
        place.alias("step"),
        total(lambda f: f.bitwiseAND(mine.bitwiseOR(earlier)) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda f: fails(f) & gone(f)).alias("redundant"),
        total(lambda f: f.bitwiseAND(F.lit(MASK)) == mine).alias("unique_fails"),
        total(lambda f: removed(f) & (f.bitwiseAND(F.lit(GOOD)) != 0)).alias("good_lost"),
        total(lambda f: removed(f) & (f.bitwiseAND(F.lit(TOXIC)) != 0)).alias("toxic_lost"),
        total(fails, orders).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """The whole report of the Parquet table at ``path``; options as in ``counted``."""
    return report(counted(spark, path, labels, **options))
