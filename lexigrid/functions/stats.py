"""Style statistics of a text or its tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigrid import fixed_values as V


def flood_runs(text: Column) -> Column:
    """Runs of three or more of one character within a line."""
    return F.regexp_extract_all(text, F.lit(V.FLOOD), F.lit(1))


def mean_length(items: Column) -> Column:
    """Mean length of strings in an array, 0 when it is empty."""
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + F.char_length(x))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0)


def text_stats(text: Column, runs: Column) -> list[Column]:
    """The nine text statistics; ``runs`` holds ``flood_runs(text)``."""
    alpha = F.filter(runs, lambda r: r.rlike("^[a-zA-Z]"))
    punct = F.filter(runs, lambda r: r.rlike("^" + V.PUNCT))
    marks = F.char_length(text) - F.char_length(F.replace(text, F.lit(V.EMOTICON_MARK), F.lit("")))
    values = (
        F.size(runs), F.size(alpha), F.size(punct),
        mean_length(runs), mean_length(alpha), mean_length(punct),
        F.regexp_count(text, F.lit(V.PUNCT + "+")),
        F.regexp_count(text, F.lit(V.DIGITS)),
        marks / len(V.EMOTICON_MARK),
    )
    return [v.cast("double").alias(n) for n, v in zip(V.TEXT_STAT_NAMES, values)]


def token_stats(tokens: Column) -> list[Column]:
    """The six token statistics of an array of tokens."""

    def total(measure) -> Column:
        return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + measure(t)).cast("double")

    def among(names):
        return F.size(F.filter(tokens, lambda t: t.isin(*names))).cast("double")

    values = (
        total(F.char_length),
        total(lambda t: F.char_length(F.regexp_extract(t, V.CAPS_AT_END, 0))),
        total(lambda t: F.regexp_count(t, F.lit(V.START_CAP))),
        among(V.URL_TOKENS), among(V.PHOTO_TOKENS), among(V.VIDEO_TOKENS),
    )
    return [v.alias(n) for n, v in zip(V.TOKEN_STAT_NAMES, values)]


def avg_sentence_length(sentence_ids: Column) -> Column:
    """Mean number of tokens for each sentence number."""
    n = F.size(F.array_distinct(sentence_ids))
    return F.when(n > 0, F.size(sentence_ids) / n).otherwise(0.0)
