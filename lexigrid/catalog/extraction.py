"""Feature extraction, vocabularies and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid import fixed_values as V
from lexigrid.catalog.base import (
    ORACLES,
    CHARS, LANGUAGE_SQL, WORDS, counts_sql, language_docs, query, split_sql, table,
)
from lexigrid.catalog.texts import (
    SENTIMENTS, _SOCIAL, lexicon, parsed_docs, parses_sql, sentiments, values_sql,
)
from lexigrid.functions.clean import social_clean, with_clean
from lexigrid.operators import estimators, svd, vectorize
from lexigrid.operators.features import (
    Custom, FunctionWords, LexiconSentiment, Meta, Ngrams, SimpleStats, WordEmbeddings,
    extract_features, one_hot,
)
from lexigrid.operators.ngrams import ngrams
from lexigrid.operators.placement import by_document
from lexigrid.operators.splits import stratified_split
from lexigrid.operators.annotate import Annotator, annotate
from lexigrid.plans.experiment import ExperimentConfig, features_of, split_and_fold
from lexigrid.session import staged

DOCS = "SELECT doc_id, text FROM documents"


@query(counts_sql(DOCS, "char", (3,), CHARS))
def char_ngrams(spark, sf_dir):
    return ngrams(by_document(language_docs(spark, sf_dir)), "char", (3,))


@query(counts_sql(DOCS, "text", (2,), WORDS))
def text_ngrams(spark, sf_dir):
    return ngrams(by_document(language_docs(spark, sf_dir)), "text")


@query(counts_sql(DOCS, "text", (1, 2, 3), WORDS))
def multi_ngrams(spark, sf_dir):
    return ngrams(by_document(language_docs(spark, sf_dir)), "text", (1, 2, 3))


_PARSED = (
    "SELECT doc_id, list(token ORDER BY nr) AS tokens, list(pos ORDER BY nr) AS tags, list(sent ORDER BY nr) AS sents"
    f" FROM ({parses_sql()}) GROUP BY doc_id"
)


@query(counts_sql(_PARSED, "token", (2,), "tokens"))
def token_ngrams(spark, sf_dir):
    return ngrams(parsed_docs(spark, sf_dir), "token", (2,))


_CLEAN_PARSED = (
    "SELECT doc_id, list(pos ORDER BY nr) AS tags"
    f" FROM ({parses_sql(f'SELECT doc_id, {_SOCIAL} AS text FROM documents')}) GROUP BY doc_id"
)


@query(counts_sql(_CLEAN_PARSED, "pos", (2,), "tags"))
def annotated_experiment(spark, sf_dir):
    """Tag pairs of cleaned text, cleaned and annotated by the experiment itself."""
    tagger = Annotator(lambda docs: annotate(docs, lexicon(spark)))
    config = ExperimentConfig("tags", extractors=[Ngrams("pos", (2,))], cleaner=social_clean, annotator=tagger)
    docs = language_docs(spark, sf_dir)
    return features_of(docs, split_and_fold(docs, config), config).select("doc_id", "feature", "value")


@query(counts_sql(_PARSED, "pos", (3,), "tags"))
def pos_ngrams(spark, sf_dir):
    return ngrams(parsed_docs(spark, sf_dir), "pos", (3,))


@query(counts_sql(f"SELECT doc_id, {_SOCIAL} AS text FROM documents", "text", (1,), WORDS))
def clean_then_ngrams(spark, sf_dir):
    """Features see the cleaned text."""
    docs = with_clean(by_document(language_docs(spark, sf_dir)), social_clean)
    return ngrams(docs, "text", (1,))


@query(
    "SELECT doc_id, token AS feature, count(*)::DOUBLE AS value"
    f" FROM ({parses_sql()}) WHERE string_split(pos, '(')[1] IN ('VNW', 'LID', 'VZ', 'BW', 'TW', 'VG') GROUP BY doc_id, token"
)
def func_words(spark, sf_dir):
    return FunctionWords()(parsed_docs(spark, sf_dir))


def _rule_sql(which: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(pos, '{r[0]}') THEN '{r[which]}'" for r in V.SENTIMENT_RULES)
    return f"CASE {cases} END"


@query(
    "SELECT p.doc_id, 'sentiment' AS feature, sum(coalesce(w.polarity, l.polarity, 0))::DOUBLE AS value"
    f" FROM (SELECT *, {_rule_sql(1)} AS tw, {_rule_sql(2)} AS tl FROM ({parses_sql()})) p"
    f" LEFT JOIN ({values_sql(SENTIMENTS)}) w(term, tag, polarity) ON w.term = p.token AND w.tag = p.tw"
    f" LEFT JOIN ({values_sql(SENTIMENTS)}) l(term, tag, polarity) ON l.term = p.lemma AND l.tag = p.tl"
    " GROUP BY p.doc_id"
)
def lexicon_sentiment(spark, sf_dir):
    return LexiconSentiment(sentiments(spark))(parsed_docs(spark, sf_dir))


_TEXT_STATS = r"""
SELECT d.doc_id, coalesce(n, 0)::DOUBLE AS flood_norm_len, coalesce(na, 0)::DOUBLE AS flood_alph_len,
  coalesce(np, 0)::DOUBLE AS flood_punc_len, round(coalesce(s / n, 0), 9) AS flood_norm_avg,
  round(CASE WHEN na > 0 THEN sa / na ELSE 0 END, 9) AS flood_alph_avg,
  round(CASE WHEN np > 0 THEN sp / np ELSE 0 END, 9) AS flood_punc_avg,
  len(regexp_extract_all(text, '[!?.,:;()"''\-]+'))::DOUBLE AS num_punc,
  len(regexp_extract_all(text, '[0-9]+'))::DOUBLE AS num_num,
  ((length(text) - length(replace(text, '_EMOTICON_', ''))) / 10)::DOUBLE AS num_emots
FROM ({src}) d LEFT JOIN (
  SELECT doc_id, count(*) AS n, sum(len) AS s,
    count(*) FILTER (WHERE regexp_matches(c, '[a-zA-Z]')) AS na, sum(len) FILTER (WHERE regexp_matches(c, '[a-zA-Z]')) AS sa,
    count(*) FILTER (WHERE regexp_matches(c, '[!?.,:;()"''\-]')) AS np, sum(len) FILTER (WHERE regexp_matches(c, '[!?.,:;()"''\-]')) AS sp
  FROM (SELECT doc_id, c, count(*)::DOUBLE AS len FROM (
      SELECT doc_id, nr, c, nr - row_number() OVER (PARTITION BY doc_id, c ORDER BY nr) AS island FROM (
        SELECT doc_id, unnest(x) AS c, unnest(range(len(x))) AS nr
        FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS x FROM ({src})))
      WHERE c <> chr(10))
    GROUP BY doc_id, c, island HAVING count(*) >= 3)
  GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


def _text_stats_sql(src: str) -> str:
    return _TEXT_STATS.replace("{src}", src)


def _wide(features, names, digits=9):
    """Feature rows as one column for each of some names."""
    return features.groupBy("doc_id").pivot("feature", list(names)).agg(F.round(F.first("value"), digits))


@query(_text_stats_sql(DOCS))
def text_stats(spark, sf_dir):
    """Flooding, punctuation, number and emoticon statistics of whole texts."""
    return _wide(SimpleStats(True, False, False)(by_document(language_docs(spark, sf_dir))), V.TEXT_STAT_NAMES)


@query(_text_stats_sql(f"SELECT doc_id, {_SOCIAL} AS text FROM documents"))
def clean_text_stats(spark, sf_dir):
    docs = with_clean(by_document(language_docs(spark, sf_dir)), social_clean)
    return _wide(SimpleStats(True, False, False)(docs), V.TEXT_STAT_NAMES)


_MARKED = "SELECT doc_id, text || ' _URL_ __URL__ _PHOTO_ __VIDEO__ ABC-9 x' AS text FROM documents"
_MARKED_PARSED = (
    "SELECT doc_id, list(token ORDER BY nr) AS tokens, list(sent ORDER BY nr) AS sents"
    f" FROM ({parses_sql(_MARKED)}) GROUP BY doc_id"
)


def _marked(spark, sf_dir):
    docs = language_docs(spark, sf_dir)
    tail = F.lit(" _URL_ __URL__ _PHOTO_ __VIDEO__ ABC-9 x")
    return annotate(docs.withColumn("text", F.concat("text", tail)), lexicon(spark))


@query(
    "SELECT doc_id, list_sum(list_transform(tokens, lambda t: length(t)))::DOUBLE AS word_len,"
    " list_sum(list_transform(tokens, lambda t: length(regexp_extract(t, '[A-Z\\-0-9]*[A-Z][A-Z\\-0-9]*(?:\\n?)\\z'))"
    " - (CASE WHEN regexp_matches(t, '[A-Z\\-0-9]*[A-Z][A-Z\\-0-9]*\\n\\z') THEN 1 ELSE 0 END)))::DOUBLE AS cap_words,"
    " list_sum(list_transform(tokens, lambda t: len(regexp_extract_all(t, '[A-Z][a-z]'))))::DOUBLE AS start_cap,"
    " len(list_filter(tokens, lambda t: t IN ('_URL_', '__URL__')))::DOUBLE AS num_urls,"
    " len(list_filter(tokens, lambda t: t IN ('_PHOTO_', '__PHOTO__')))::DOUBLE AS num_phots,"
    " len(list_filter(tokens, lambda t: t IN ('_VIDEO_', '__VIDEO__')))::DOUBLE AS num_vids"
    f" FROM ({_MARKED_PARSED})"
)
def token_stats(spark, sf_dir):
    return _wide(SimpleStats(False, True, False)(_marked(spark, sf_dir)), V.TOKEN_STAT_NAMES)


@query(
    "SELECT doc_id, 'avg_sent_len' AS feature, round(len(sents)::DOUBLE / len(list_distinct(sents)), 9) AS value"
    f" FROM ({_PARSED})"
)
def sentence_length(spark, sf_dir):
    rows = SimpleStats(False, False, True)(parsed_docs(spark, sf_dir))
    return rows.withColumn("value", F.round("value", 9))


def _long(sql: str) -> str:
    """Statistics in columns as feature rows."""
    return f"SELECT doc_id, feature, value FROM (UNPIVOT ({sql}) ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME feature VALUE value)"


@query(
    f"{_long(ORACLES['text_stats'])} UNION ALL {_long(ORACLES['token_stats'].replace(_MARKED_PARSED, _PARSED))}"
    f" UNION ALL {ORACLES['sentence_length']}"
)
def stat_groups(spark, sf_dir):
    """All three groups at once."""
    return SimpleStats()(parsed_docs(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _word_vectors(spark, sf_dir):
    """The number of a vector for every word, its MD5 modulo their number; and the vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    size = vectors.count()
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    number = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % size
    return words.withColumn("vec_id", number), vectors.select("vec_id", "embedding")


@query(
    "WITH w AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id, count(*)::DOUBLE AS n"
    " FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) GROUP BY 1, 2),"
    " e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)"
    " SELECT doc_id, 'emb_' || i AS feature, round(sum(n * x) / sum(n), 6) AS value FROM w JOIN e ON e.vec_id = w.vec_id GROUP BY doc_id, i"
)
def embedding_mean(spark, sf_dir):
    words, vectors = _word_vectors(spark, sf_dir)
    rows = WordEmbeddings(staged(words, "words"), 64, vectors)(by_document(language_docs(spark, sf_dir)))
    return rows.withColumn("value", F.round("value", 6))


@query(
    "SELECT doc_id, 'meta_source=' || source AS feature, 1.0::DOUBLE AS value FROM documents"
    " UNION ALL SELECT doc_id, 'meta_n_chars', n_chars::DOUBLE FROM documents"
)
def meta_features(spark, sf_dir):
    return Meta(("source", "n_chars"))(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, 'lang=' || lang AS feature, 1.0::DOUBLE AS value FROM documents")
def one_hot_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("name", F.lit("lang"))
    return one_hot(docs, "name", "lang")


def _vowels_first(text, parse):
    return {"text-": float(sum(text.count(v) for v in "aeiou")), "first": text[:1]}


_FIRST_SQL = "SELECT doc_id, 'first=' || substr(text, 1, 1) AS feature, 1.0::DOUBLE AS value FROM documents"
_VOWEL_SQL = "SELECT doc_id, 'text-' AS feature, len(regexp_extract_all(text, '[aeiou]'))::DOUBLE AS value FROM documents"


@query(f"{_VOWEL_SQL} UNION ALL {_FIRST_SQL}")
def custom_extractor(spark, sf_dir):
    """Features from a Python function."""
    return Custom(_vowels_first, "vowels")(by_document(language_docs(spark, sf_dir)))


@query(
    f"SELECT doc_id, feature, value FROM ({counts_sql(DOCS, 'text', (1,), WORDS)}) WHERE feature <> 'text-'"
    f" UNION ALL {_VOWEL_SQL} UNION ALL {_FIRST_SQL}"
    " UNION ALL SELECT doc_id, 'meta_n_chars', n_chars::DOUBLE FROM documents"
)
def merge_features(spark, sf_dir):
    """Several extractors; the name both give holds the value of the later."""
    docs = by_document(table(spark, sf_dir, "documents"))
    return extract_features(docs, [Ngrams("text", (1,)), Custom(_vowels_first), Meta(("n_chars",))])


# Vocabulary, labels, matrix.

_CHAR3 = counts_sql(DOCS, "char", (3,), CHARS)
_WORD1 = counts_sql(DOCS, "text", (1,), WORDS)


def _char3(spark, sf_dir, attributes=None, keep=()):
    return ngrams(by_document(language_docs(spark, sf_dir), attributes), "char", (3,), keep=keep)


def _split(spark, sf_dir):
    return stratified_split(language_docs(spark, sf_dir))


@query(f"SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM (SELECT DISTINCT feature FROM ({_CHAR3}))")
def vocabulary(spark, sf_dir):
    return vectorize.fit_vocabulary(_char3(spark, sf_dir))


@query(
    f"WITH f AS MATERIALIZED ({_WORD1}), s AS MATERIALIZED ({split_sql(LANGUAGE_SQL)}), v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx"
    " FROM (SELECT DISTINCT feature FROM f JOIN s ON f.doc_id = s.doc_id WHERE split = 'train'))"
    " SELECT f.doc_id, v.idx, f.value FROM f JOIN s ON f.doc_id = s.doc_id JOIN v ON v.feature = f.feature WHERE split = 'test'"
)
def vectorize_holdout(spark, sf_dir):
    """Test rows in the vocabulary of the training rows; new words are dropped."""
    docs = by_document(language_docs(spark, sf_dir), _split(spark, sf_dir).drop("label"))
    rows = staged(ngrams(docs, "text", (1,), keep=["split"]), "features")
    vocab = staged(vectorize.fit_vocabulary(rows.where("split = 'train'")), "vocabulary")
    return vectorize.transform(rows.where("split = 'test'"), vocab)


_ENGLISH = "SELECT doc_id, text FROM documents WHERE lang = 'en'"


@query(
    f"WITH f AS MATERIALIZED ({counts_sql(_ENGLISH, 'text', (1,), WORDS)}), v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx"
    " FROM (SELECT DISTINCT feature FROM f)) SELECT doc_id, count(*) AS n_cells, sum(idx)::BIGINT AS idx, sum(value) AS value,"
    " false AS labelled FROM f JOIN v USING (feature) GROUP BY doc_id"
    f" UNION ALL SELECT doc_id, count(*), NULL, sum(value), true FROM ({_WORD1}) GROUP BY doc_id"
)
def single_class_matrix(spark, sf_dir):
    """Rows of one language have cells and no labels; rows of all languages have both."""
    parts = []
    for docs in (language_docs(spark, sf_dir).where("label = 'en'"), language_docs(spark, sf_dir)):
        rows = staged(ngrams(by_document(docs), "text", (1,)), "features")
        _, cells, labels = vectorize.fit_transform(rows, docs)
        sums = cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.sum("idx").alias("idx"), F.sum("value").alias("value"))
        if labels is not None:
            sums = sums.join(labels.where("label_idx >= 0").select("doc_id"), "doc_id").withColumn("idx", F.lit(None).cast("long"))
        parts.append(sums.withColumn("labelled", F.lit(labels is not None)))
    return parts[0].unionByName(parts[1])


@query("SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_idx FROM (SELECT DISTINCT source AS label FROM documents)")
def label_index(spark, sf_dir):
    return vectorize.fit_labels(table(spark, sf_dir, "documents").withColumnRenamed("source", "label"))


@query(
    "SELECT doc_id, source AS label, dense_rank() OVER (ORDER BY source) - 1 AS label_idx, source AS decoded FROM documents"
)
def encode_decode_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    labels = staged(vectorize.fit_labels(docs), "labels")
    encoded = vectorize.encode_labels(docs, labels)
    back = labels.withColumnRenamed("label", "decoded")
    return vectorize.decode_labels(encoded, back)


@query(
    f"SELECT split, count(*) AS n_rows, (SELECT count(DISTINCT feature) FROM ({_CHAR3})) AS n_features"
    f" FROM ({split_sql(LANGUAGE_SQL)}) GROUP BY split"
)
def matrix_shape(spark, sf_dir):
    return vectorize.matrix_shape(_char3(spark, sf_dir), _split(spark, sf_dir))


@query(
    f"WITH f AS ({_WORD1}) SELECT doc_id, (SELECT count(DISTINCT feature) FROM f) AS size, count(*) AS nnz,"
    " sum(value) AS total FROM f GROUP BY doc_id"
)
def sparse_vectors(spark, sf_dir):
    """One sparse vector for each document, described by size, cells and sum."""
    rows = staged(ngrams(by_document(language_docs(spark, sf_dir)), "text", (1,)), "features")
    vocab = staged(vectorize.fit_vocabulary(rows), "vocabulary")
    vectors = estimators.to_vectors(vectorize.transform(rows, vocab), vocab.count())
    describe = F.udf(
        lambda v: (int(v.size), int(v.numNonzeros()), float(v.values.sum())), "size bigint, nnz bigint, total double"
    )
    return vectors.select("doc_id", describe("features").alias("d")).select("doc_id", "d.*")


@query(
    f"WITH f AS MATERIALIZED ({_WORD1}), s AS MATERIALIZED ({split_sql(LANGUAGE_SQL)}), m AS (SELECT feature, max(abs(value)) AS m FROM f JOIN s ON f.doc_id = s.doc_id"
    " WHERE split = 'train' GROUP BY feature) SELECT f.doc_id, f.feature, round(f.value / m.m, 9) AS value"
    " FROM f JOIN s ON f.doc_id = s.doc_id JOIN m ON m.feature = f.feature WHERE split = 'test'"
)
def max_abs(spark, sf_dir):
    docs = by_document(language_docs(spark, sf_dir), _split(spark, sf_dir).drop("label"))
    rows = staged(ngrams(docs, "text", (1,), keep=["split"]), "features")
    maxima = staged(vectorize.fit_max_abs(rows.where("split = 'train'")), "maxima")
    scaled = vectorize.scale_max_abs(rows.where("split = 'test'"), maxima)
    return scaled.select("doc_id", "feature", F.round("value", 9).alias("value"))


@query(
    f"WITH f AS ({_CHAR3}), w AS (SELECT f.doc_id, f.feature, f.value * i.idf AS value FROM f JOIN"
    " (SELECT feature, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY feature) i"
    " ON i.feature = f.feature) SELECT doc_id, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM w"
)
def tf_idf(spark, sf_dir):
    rows = staged(_char3(spark, sf_dir), "features")
    idf = staged(vectorize.fit_idf(rows, table(spark, sf_dir, "documents").count()), "idf")
    return vectorize.tf_idf(rows, idf).withColumn("value", F.round("value", 6))


@query()
def truncated_svd(spark, sf_dir):
    """Documents in the space of the first components of character trigrams."""
    rows = staged(_char3(spark, sf_dir), "features")
    vocab = staged(vectorize.fit_vocabulary(rows), "vocabulary")
    cells = staged(vectorize.transform(rows, vocab), "cells")
    model = svd.fit(cells, 3)
    reduced = svd.project(cells, model)
    return reduced.select("doc_id", *[F.round(c, 6).alias(c) for c in ("v0", "v1", "v2")])


def _power_sql(top: int, squarings: int = 7) -> str:
    """Singular values of the text statistics: the matrix of inner products is squared until one direction is left, and deflated."""
    names = (*V.TEXT_STAT_NAMES,)
    sql = (
        f"WITH x AS MATERIALIZED (UNPIVOT ({ORACLES['text_stats']}) ON {', '.join(names)} INTO NAME f VALUE v),"
        " g0 AS MATERIALIZED (SELECT a.f AS i, b.f AS j, sum(a.v * b.v) AS x FROM x a JOIN x b ON a.doc_id = b.doc_id GROUP BY a.f, b.f)"
    )
    for c in range(top):
        sql += f", p{c}_0 AS (SELECT * FROM g{c})"
        for s in range(squarings):
            sql += (
                f", q{c}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM p{c}_{s} a JOIN p{c}_{s} b ON a.j = b.i GROUP BY a.i, b.j),"
                f" p{c}_{s + 1} AS MATERIALIZED (SELECT i, j, x / (SELECT max(abs(x)) FROM q{c}_{s}) AS x FROM q{c}_{s})"
            )
        last = f"p{c}_{squarings}"
        sql += (
            f", v{c} AS MATERIALIZED (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM {last}"
            f" WHERE j = (SELECT arg_max(j, x) FROM {last} WHERE i = j)),"
            f" l{c} AS MATERIALIZED (SELECT sum(a.x * g.x * b.x) AS l FROM g{c} g JOIN v{c} a ON a.i = g.i JOIN v{c} b ON b.i = g.j),"
            f" g{c + 1} AS MATERIALIZED (SELECT g.i, g.j, g.x - l * a.x * b.x AS x FROM g{c} g JOIN v{c} a ON a.i = g.i JOIN v{c} b ON b.i = g.j, l{c})"
        )
    return sql + " " + " UNION ALL ".join(f"SELECT {c} AS component, round(sqrt(l), 3) AS singular_value FROM l{c}" for c in range(top))


@query(_power_sql(3))
def singular_values(spark, sf_dir):
    """The first singular values of the text statistics of all documents."""
    rows = staged(SimpleStats(True, False, False)(by_document(language_docs(spark, sf_dir))), "features")
    cells = staged(vectorize.transform(rows, staged(vectorize.fit_vocabulary(rows), "vocabulary")), "cells")
    found = svd.fit(cells, 3, iterations=8)
    table = [(c, round(v, 3)) for c, v in enumerate(found.singular_values)]
    return spark.createDataFrame(table, "component int, singular_value double")
