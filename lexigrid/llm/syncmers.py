"""Document fingerprints from closed syncmers, in SQL functions only.

A k-mer of code points is an anchor if the smallest hash among its inner
s-mers is that of the first or the last one.  Whether it is depends on nothing
outside the k-mer, so an edit moves no anchor that does not overlap it, and
equal passages have equal anchors at shifted positions.

``anchors`` gives all of them with their positions; ``sketch`` keeps one hash in
``SHARE``, those below a fixed bound, so that a sketch grows with its text, and
the ``SIZE`` smallest at least.  ``likeness`` estimates from two sketches which
share of all anchors two texts have in common: below the bound that both are
complete to, it is exact.

An edited text keeps the anchors of what was not touched, as they depend on
nothing else; only the new end and the seam are read again.

A text's code points are read as UTF-32, where a slice takes the same time
anywhere in the text; ``transform(array(x), v -> ...)`` binds a value so that it
is worked out once.  Text stays in its row: nothing is exploded or shuffled.

Defined results: null counts as empty; a text that is shorter than k or has no
anchor gets one for the whole of it, at position 0; equal texts have equal
fingerprints, also in repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.llm.tables import lookup
from lexigrid.session import staged

K, S = 12, 8
SIZE, SHARE = 64, 16
BELOW = (1 << 31) // SHARE  # hashes have 31 bits


_SMALL = "cast(shiftrightunsigned(xxhash64({}), 33) AS int)"


def anchors(text: str, k: int = K, s: int = S, whole: bool = True) -> Column:
    """``array<struct<pos:int, hash:int>>`` of the anchors of column ``text``, by position.

    With ``whole``, a text without any has one for all of it.
    """
    width = k - s + 1
    t = f"coalesce({text}, '')"
    n = f"char_length({t})"
    inner = ", ".join(f"get(h, i + {j})" for j in range(width))
    edges = f"get(h, i), get(h, i + {width - 1})"
    hashes = f"transform(sequence(0, {n} - {s}), i -> xxhash64(substring(b, 4 * i + 1, {4 * s})))"
    places = f"filter(sequence(0, {n} - {k}), i -> least({inner}) IN ({edges}))"
    found = f"transform({places}, i -> struct(i AS pos, {_SMALL.format(edges)} AS hash))"
    bound = f"get(transform(array({hashes}), h -> {found}), 0)"
    some = f"CASE WHEN {n} >= {k} THEN get(transform(array(encode({t}, 'UTF-32')), b -> {bound}), 0) END"
    other = f"array(struct(0 AS pos, {_SMALL.format(t)} AS hash))" if whole else "cast(array() AS array<struct<pos:int,hash:int>>)"
    return F.expr(f"get(transform(array({some}), a -> CASE WHEN size(a) > 0 THEN a ELSE {other} END), 0)")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kept(hashes: Column) -> Column:
    """The distinct hashes below the bound in order, or the ``SIZE`` smallest if those are fewer."""
    low = F.array_distinct(F.filter(hashes, lambda x: x < BELOW))
    some = F.slice(F.sort_array(F.array_distinct(hashes)), 1, SIZE)
    return _once(low, lambda x: F.when(F.size(x) >= SIZE, F.sort_array(x)).otherwise(some))


def sketch(found: Column) -> Column:
    """The distinct hashes of anchors that a fingerprint keeps, in order."""
    return _once(found["hash"], _kept)


def _or_whole(sketched: Column, text: str) -> Column:
    return _once(sketched, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.expr(_SMALL.format(text)))))


def fingerprint(sketched: Column) -> Column:
    """A sketch as a string: eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of either text that both have, among those below the bound that both sketches are complete to."""

    def complete(sketched: Column) -> Column:
        top = F.greatest(F.lit(BELOW - 1), F.array_max(sketched))
        return F.when(F.size(sketched) < SIZE, F.lit((1 << 31) - 1)).otherwise(top)

    upto = F.least(complete(a), complete(b))
    low = lambda hashes: F.size(_once(upto, lambda m: F.filter(hashes, lambda x: x <= m)))
    return low(F.array_intersect(a, b)) / low(F.array_union(a, b))


def _neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, owner, most``: the document each id is the next one of, in
    descending order of ids and round the end, and how much that one may take."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.floor(n / 3)).cast("int").alias("most"))
    down = F.col("doc_id").desc()
    placed = ids.repartitionByRange(down).sortWithinPartitions(down).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed, "ids").withColumn("_part", F.shiftright("_at", 33))
    ends = placed.groupBy("_part").agg(
        F.max_by(F.struct("doc_id", "most"), "doc_id").alias("first"), F.min_by(F.struct("doc_id", "most"), "doc_id").alias("last")
    )
    # one row for each range partition
    order, every = Window.orderBy("_part"), Window.partitionBy()
    final = F.max_by("last", "_part").over(every)
    ends = ends.select("_part", F.coalesce(F.lag("last").over(order), final).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at")
    before = F.coalesce(F.lag(F.struct("doc_id", "most")).over(inside), F.col("_before"))
    return placed.join(F.broadcast(ends), "_part").select("doc_id", before["doc_id"].alias("owner"), before["most"].alias("most"))


def with_edited(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited, sketch, edited_sketch, next_sketch`` for every row of ``docs(doc_id, text)``.

    ``edited`` is the text with its last third replaced by the beginning of the
    document with the next smaller id (after the smallest: the largest).  Each
    row is fingerprinted once and sent to its own id and, with as much of its
    beginning as is needed, to the id it follows.  Rows without an id are
    followed by nothing.  If an id is repeated, all its rows have the same
    neighbours, and of several next texts the smallest head counts.
    """
    rows = lookup(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _neighbours(docs), "doc_id", "left")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    none = F.array().cast("array<int>")

    def both_of(a: Column) -> Column:
        untouched = _once(F.col("_upto"), lambda m: F.filter(a, lambda x: x["pos"] <= m))
        return F.struct(_or_whole(sketch(a), "text").alias("sketch"), sketch(untouched).alias("head"))

    rows = rows.withColumn("_upto", n - cut - K)
    rows = rows.select("*", F.inline(F.transform(F.array(anchors("text", whole=False)), both_of)))
    nothing = F.lit(None)
    own = F.struct(
        F.col("doc_id").alias("key"), F.lit(1).alias("role"), F.col("text"), F.col("sketch"), F.col("head"),
    )
    ahead = F.struct(
        F.col("owner").alias("key"), F.lit(0).alias("role"), F.substring("text", F.lit(1), F.coalesce("most", F.lit(0))).alias("text"),
        F.col("sketch"), none.alias("head"),
    )
    sent = rows.select(F.explode(F.filter(F.array(own, ahead), lambda r: (r["role"] == 1) | r["key"].isNotNull())).alias("r"))
    sent = sent.select("r.key", "r.role", "r.text", "r.sketch", "r.head")
    first = Window.partitionBy("key").orderBy("role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.first(F.when(F.col("role") == 0, F.struct("text", "sketch")), ignorenulls=True).over(first)
    met = sent.withColumn("ahead", F.when(F.col("key").isNotNull(), ahead).otherwise(nothing)).where("role = 1")
    edited = F.concat(
        F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("ahead.text", F.lit("")), F.lit(1), cut)
    )
    met = met.select(
        F.col("key").alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "head",
        F.col("ahead.sketch").alias("next_sketch"), F.greatest(F.lit(1), n - cut - K + 2).alias("_from"),
    )
    met = met.withColumn("_end", F.expr("substring(edited, _from, char_length(edited))"))
    new = sketch(anchors("_end", whole=False))
    both = _or_whole(_once(F.array_union(F.col("head"), new), _kept), "edited")
    return met.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", F.explode(F.array(both)).alias("edited_sketch"))
