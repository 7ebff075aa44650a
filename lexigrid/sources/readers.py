"""Sources of labelled text.

Every reader returns ``doc_id, text, label`` and, where asked for, ``parse``
and ``meta``, so that all operators can rely on these names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrid.operators.annotate import parse_json
from lexigrid.operators.ranking import exact_rank
from lexigrid.session import staged


def read_docs(
    df: DataFrame,
    text: str | Column,
    label: str | Column | None = None,
    id: str | Column = "doc_id",
    meta: Sequence[str] = (),
    categories: Sequence[str] | None = None,
    parse: str | Column | None = None,
) -> DataFrame:
    """Bring any DataFrame to the document columns.

    ``categories`` keeps the named labels only and reaches the file scan as a
    pushed filter.
    """

    def as_col(c):
        return F.col(c) if isinstance(c, str) else c

    label_col = F.lit(None).cast("string") if label is None else as_col(label)
    if categories is not None:
        df = df.where(label_col.isin(*categories))
    columns = [
        as_col(id).cast("bigint").alias("doc_id"),
        as_col(text).alias("text"),
        label_col.cast("string").alias("label"),
    ]
    if parse is not None:
        columns.append(as_col(parse).alias("parse"))
    columns += [F.col(m) for m in meta]
    return df.select(*columns)


def read_csv(
    spark: SparkSession,
    path: str,
    data: int | str,
    label: int | str | None = None,
    parse: int | str | None = None,
    features: Sequence[int | str] | int | str | None = None,
    no_header: bool = False,
    selection: Mapping[str, int] | None = None,
) -> DataFrame:
    """CSV rows as documents, columns given by position or by name.

    Quoted fields may hold line breaks and doubled quotes.  ``features`` are
    kept under their own names as meta data; ``parse`` is a JSON array with
    token, lemma, tag and sentence for each word.
    """
    header = isinstance(data, str) or not no_header
    df = (
        spark.read.option("header", header)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )

    def name(c: int | str) -> str:
        return df.columns[c] if isinstance(c, int) else c

    if features is None:
        features = []
    elif isinstance(features, (int, str)):
        features = [features]
    columns = [F.monotonically_increasing_id().alias("doc_id"), F.col(f"`{name(data)}`").alias("text")]
    columns.append(
        (F.lit(None) if label is None else F.col(f"`{name(label)}`")).cast("string").alias("label")
    )
    if parse is not None:
        columns.append(parse_json(F.col(f"`{name(parse)}`")).alias("parse"))
    columns += [F.col(f"`{name(c)}`") for c in features]
    # staged, so that ids stay what they are however the files are read again
    docs = staged(df.select(*columns), "csv")
    return label_cap(docs, selection) if selection else docs


def read_texts(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """A few raw strings, as given to a deployed model by hand."""
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
        "label", F.lit(None).cast("string")
    )


def chain(sources: Mapping[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources, duplicates kept; a mapping adds ``source``.

    Names are aligned; columns a source lacks are null.  Row ``i`` of source
    ``k`` of ``n`` gets the id ``i * n + k``, so documents of different sources
    that had the same number stay apart.
    """
    if isinstance(sources, Mapping):
        frames = [df.withColumn("source", F.lit(n)) for n, df in sources.items()]
    else:
        frames = list(sources)
    frames = [df.withColumn("doc_id", F.col("doc_id") * len(frames) + k) for k, df in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label_cap(docs: DataFrame, caps: Mapping[str, int], order: str = "doc_id") -> DataFrame:
    """At most ``caps[label]`` rows of a label, the first ones by ``order``.

    -1 means all, and so does not being listed.  Only ids of capped labels are
    ranked, over a range partitioning, to find the last row each label keeps.
    Texts are then filtered where they lie.
    """
    limited = {k: v for k, v in caps.items() if v >= 0}
    if not limited:
        return docs

    def by_label(values: Mapping[str, int]) -> Column:
        return F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in values.items()], F.lit(None))

    keys = docs.where(F.col("label").isin(*limited)).select("label", order)
    last = (
        exact_rank(keys, [order], ["label"], "_rank")
        .where(F.col("_rank") == by_label(limited) - 1)
        .select("label", F.col(order).alias("_last"))
    )
    # at most one row for each label in ``caps``; none for a label with fewer rows
    marked = docs.join(F.broadcast(last), "label", "left")
    closed = F.coalesce(by_label(limited) == 0, F.lit(False))
    beyond = F.coalesce(F.col(order) > F.col("_last"), F.lit(False))
    return marked.where(~closed & ~beyond).select(*docs.columns)


def head_docs(docs: DataFrame, n: int = 5, order: str = "doc_id") -> DataFrame:
    """The first ``n`` documents."""
    return docs.orderBy(order).limit(n)
