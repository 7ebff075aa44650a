"""Extractors: from documents to ``doc_id, *keep, feature, value``.

An extractor is any function ``(docs, keep) -> DataFrame`` of that shape;
``keep`` names document columns, such as label and fold, that ride along.
Documents placed by id beforehand (``placement.by_document``) are counted
without a further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lexigrid import fixed_values as V
from lexigrid.functions.stats import avg_sentence_length, flood_runs, text_stats, token_stats
from lexigrid.operators.annotate import Annotator
from lexigrid.operators.lookup import BROADCAST_BYTES, bytes_of, lookup_join
from lexigrid.operators.ngrams import ngrams
from lexigrid.session import staged

Extractor = Callable[[DataFrame, Sequence[str]], DataFrame]


def unstack(df: DataFrame, names: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Named columns as ``feature, value`` rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*ids, F.inline(pairs))


@dataclass(frozen=True)
class Ngrams:
    """N-grams of one level; the default is bigrams."""

    level: str = "token"
    n_list: tuple[int, ...] = (2,)

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return ngrams(docs, self.level, self.n_list, keep=keep)

    def __str__(self) -> str:
        return f"NGrams(level={self.level}, n_list={list(self.n_list)})"


@dataclass(frozen=True)
class FunctionWords:
    """Counts of tokens whose tag, cut at the first bracket, is a function tag."""

    tags: tuple[str, ...] = tuple(V.FUNCTION_TAGS["nl"])

    @classmethod
    def for_language(cls, lang: str) -> "FunctionWords":
        if lang not in V.FUNCTION_TAGS:
            raise NotImplementedError(f"no function word tags for {lang!r}")
        return cls(tuple(V.FUNCTION_TAGS[lang]))

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        words = docs.select("doc_id", *keep, F.inline("parse"))
        return (
            words.where(F.substring_index("pos", "(", 1).isin(*self.tags))
            .groupBy("doc_id", *keep, F.col("token").alias("feature"))
            .agg(F.count("*").cast("double").alias("value"))
        )

    def __str__(self) -> str:
        return "func_words"


def sentiment_tags(pos: Column) -> tuple[Column, Column]:
    """Lexicon tags to look the word and the lemma up with, null for none."""
    word, lemma = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, for_word, for_lemma in reversed(V.SENTIMENT_RULES):
        found = pos.rlike(pattern)
        word = F.when(found, F.lit(for_word)).otherwise(word)
        lemma = F.when(found, F.lit(for_lemma)).otherwise(lemma)
    return word, lemma


@dataclass(frozen=True)
class LexiconSentiment:
    """Sum of polarities: by word and tag, else by lemma and tag, else 0.

    ``lexicon`` has unique ``term, tag`` with ``polarity``.  Equal tokens of a
    document are counted first and looked up once.
    """

    lexicon: DataFrame

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        ids = ["doc_id", *keep]
        words = docs.select(*ids, F.inline_outer("parse"))
        for_word, for_lemma = sentiment_tags(F.col("pos"))
        counted = (
            words.select(*ids, "token", "lemma", for_word.alias("_tw"), for_lemma.alias("_tl"))
            .groupBy(*ids, "token", "lemma", "_tw", "_tl")
            .agg(F.count("*").alias("_n"))
        )
        by_word = self.lexicon.select(
            F.col("term").alias("token"), F.col("tag").alias("_tw"), F.col("polarity").alias("_pw")
        )
        by_lemma = self.lexicon.select(
            F.col("term").alias("lemma"), F.col("tag").alias("_tl"), F.col("polarity").alias("_pl")
        )
        scored = lookup_join(counted, by_word, ["token", "_tw"], "left")
        scored = lookup_join(scored, by_lemma, ["lemma", "_tl"], "left")
        value = F.sum(F.col("_n") * F.coalesce("_pw", "_pl", F.lit(0.0)))
        return scored.groupBy(*ids).agg(value.alias("value")).select(
            *ids, F.lit("sentiment").alias("feature"), "value"
        )

    def __str__(self) -> str:
        return "sentiment"


@dataclass(frozen=True)
class SimpleStats:
    """Text, token and sentence statistics; the last two need a parse."""

    text: bool = True
    token: bool = True
    sentence_length: bool = True

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        ids = ["doc_id", *keep]
        needs_parse = self.token or self.sentence_length
        if needs_parse and "parse" not in docs.columns:
            raise ValueError("token and sentence statistics need a parse column")
        source = docs.select(*ids, "text", *(["parse"] if needs_parse else []))
        columns: list[Column] = []
        if self.text:
            source = source.withColumn("_runs", flood_runs(F.col("text")))
            columns += text_stats(F.col("text"), F.col("_runs"))
        if self.token:
            columns += token_stats(F.transform("parse", lambda p: p["token"]))
        if self.sentence_length:
            columns.append(avg_sentence_length(F.transform("parse", lambda p: p["sent"])).alias("avg_sent_len"))
        wide = source.select(*ids, *columns)
        return unstack(wide, [c for c in wide.columns if c not in ids], ids)

    def __str__(self) -> str:
        return "simple_stats"


@dataclass(frozen=True)
class WordEmbeddings:
    """Mean vector of the words of a document, as ``emb_<i>``.

    ``vectors`` has unique ``token`` with ``embedding`` of ``size`` numbers or,
    where words share vectors, with the ``vec_id`` of a row of ``table``.  Words
    without a vector are left out.  Words are counted by document and looked up
    by number; numbers lie with their documents before vectors come, and
    vectors are added up number by number: sums of numbers stay in a hash table,
    where vectors as objects would be sorted and spilled row by row.

    Vectors always go to the documents, by broadcast: met by shuffle, a document
    would leave a sum of ``size`` numbers with nearly every word it has.  A table
    of more than ``broadcast_bytes`` goes in as many blocks, one after the other,
    and each reads the numbers of its own vectors only.
    """

    vectors: DataFrame
    size: int
    table: DataFrame | None = None
    broadcast_bytes: int = BROADCAST_BYTES

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        ids = ["doc_id", *keep]
        words, table = self.vectors, self.table
        if table is None:
            words = staged(words.withColumn("vec_id", F.monotonically_increasing_id()), "vectors")
            table = words.select("vec_id", "embedding")
        counted = (
            docs.select(*ids, F.explode(F.split("text", " ")).alias("token"))
            .groupBy(*ids, "token")
            .agg(F.count("*").alias("_n"))
        )
        words = words.select("token", "vec_id")
        size = bytes_of(words)
        numbers = lookup_join(counted, words, ["token"], broadcast_bytes=self.broadcast_bytes, table_bytes=size)
        numbers = numbers.select(*ids, "vec_id", F.col("_n").cast("double").alias("_n"))
        if size > self.broadcast_bytes:  # words have been shuffled: numbers go back to their documents before vectors come
            numbers = numbers.repartition("doc_id")
        table = table.where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
        blocks = -(-bytes_of(table) // self.broadcast_bytes)
        if blocks <= 1:
            means = self._sums(numbers.join(F.broadcast(table), "vec_id"), ids)
        else:
            block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
            numbers = staged(numbers.withColumn("_block", block), "numbers", by="_block")
            parts = []
            for b in range(blocks):
                met = numbers.where(F.col("_block") == b).join(F.broadcast(table.where(block == b)), "vec_id")
                parts.append(staged(self._sums(met, ids), "sums"))
            names = ["_n", *[f"_{i}" for i in range(self.size)]]
            means = reduce(DataFrame.unionByName, parts).groupBy(*ids).agg(*[F.sum(n).alias(n) for n in names])
        pairs = [F.struct(F.lit(f"emb_{i}").alias("feature"), (F.col(f"_{i}") / F.col("_n")).alias("value")) for i in range(self.size)]
        return means.select(*ids, F.inline(F.array(*pairs)))

    def _sums(self, met: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Number of words and sum of their vectors by document."""
        odd = F.raise_error(F.format_string("a vector has %s numbers, not " + str(self.size), F.size("embedding")))
        weight = F.when(F.size("embedding") == self.size, F.col("_n")).otherwise(odd.cast("double"))
        sums = [F.sum(F.col("_w") * F.get("embedding", F.lit(i)).cast("double")) for i in range(self.size)]
        met = met.select(*ids, "embedding", weight.alias("_w"))
        return met.groupBy(*ids).agg(F.sum("_w").alias("_n"), *[x.alias(f"_{i}") for i, x in enumerate(sums)])

    def __str__(self) -> str:
        return "word_embeddings"


@dataclass(frozen=True)
class Meta:
    """Meta data columns: numbers keep their value, strings are one-hot."""

    columns: tuple[str, ...]

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        pairs = []
        for name in self.columns:
            if isinstance(docs.schema[name].dataType, T.NumericType):
                feature, value = F.lit(f"meta_{name}"), F.col(name).cast("double")
            else:
                feature = F.concat(F.lit(f"meta_{name}="), F.col(name).cast("string"))
                value = F.when(F.col(name).isNotNull(), 1.0)
            pairs.append(F.struct(feature.alias("feature"), value.alias("value")))
        rows = docs.select("doc_id", *keep, F.inline(F.array(*pairs)))
        return rows.where(F.col("value").isNotNull())

    def __str__(self) -> str:
        return "meta"


@dataclass(frozen=True)
class Custom:
    """Features from a Python function ``(text, parse) -> {name: number}``.

    A string value becomes a one-hot feature ``name=value``.  The function
    sees one document after another within Arrow batches.
    """

    function: Callable
    name: str = "custom"

    def __call__(self, docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        function = self.function

        @F.pandas_udf("array<struct<feature:string,value:double>>")
        def extract(texts: pd.Series, parses: pd.Series) -> pd.Series:
            out = []
            for text, parse in zip(texts, parses):
                found = function(text, parse)
                out.append(
                    [
                        {"feature": f"{k}={v}", "value": 1.0}
                        if isinstance(v, str)
                        else {"feature": k, "value": float(v)}
                        for k, v in found.items()
                    ]
                )
            return pd.Series(out)

        parse = F.col("parse") if "parse" in docs.columns else F.lit(None).cast("string")
        return docs.select("doc_id", *keep, F.inline(extract("text", parse)))

    def __str__(self) -> str:
        return self.name


def custom_cleaner(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python ``str -> str`` cleaner as a column function."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return clean


def one_hot(df: DataFrame, name: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature rows with string values as one-hot features ``name=value``."""
    return df.select(
        "doc_id", *keep, F.concat_ws("=", name, value).alias("feature"), F.lit(1.0).alias("value")
    )


def merge_features(parts: Sequence[DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """All features of all parts; on equal names the later part wins."""
    if len(parts) == 1:
        return parts[0]
    tagged = [p.withColumn("_ord", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return rows.groupBy("doc_id", *keep, "feature").agg(F.max_by("value", "_ord").alias("value"))


def extract_features(
    docs: DataFrame,
    extractors: Sequence[Extractor],
    cleaner: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = (),
    annotator: Annotator | None = None,
) -> DataFrame:
    """Clean and annotate, run every extractor in order and merge what they give."""
    if annotator is not None and annotator.raw:
        docs = annotator.fill(docs)
    if cleaner is not None:
        docs = docs.withColumn("text", cleaner(F.col("text")))
    if annotator is not None and not annotator.raw:
        docs = annotator.fill(docs)
    return merge_features([e(docs, keep) for e in extractors], keep)
