"""The experiment registry and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.catalog.base import CHARS, ROLE_SQL, averages_sql, language_docs, query, quality_docs, role_docs, table
from lexigrid.catalog.models import _BEST, _items, _language_model, role_sql
from lexigrid.operators import explain, naive_bayes
from lexigrid.operators.features import Ngrams
from lexigrid.operators.placement import by_document
from lexigrid.plans.experiment import Experiment, ExperimentConfig
from lexigrid.plans.serve import best_only, classify
from lexigrid.session import new_path
from lexigrid.sources.readers import head_docs
from lexigrid.sources.registry import RECORD, Registry


def _registry(spark) -> Registry:
    return Registry(spark, new_path(spark, "registry"))


# One record for each source: how well its largest language guesses the rest.
_BASELINES = (
    "SELECT 'baselines' AS project, source AS name, 'majority' AS clf, 'majority(' || arg_min(lang, (-n, lang)) || ')' AS clf_full,"
    " 'label' AS features, source AS data, round(max(n) / sum(n), 6) AS test_score, round(sum(c) / 1000.0::DOUBLE, 1) AS dur"
    " FROM (SELECT source, lang, count(*)::DOUBLE AS n, sum(n_chars)::DOUBLE AS c FROM documents GROUP BY source, lang) GROUP BY source"
)


def _saved_baselines(spark, sf_dir) -> Registry:
    """Records of all sources, saved twice: the second time they replace the first."""
    sizes = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("c")
    )
    largest = F.get(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "lang"))), F.lit(0))["lang"]
    found = sizes.groupBy("source").agg(
        largest.alias("lang"),
        F.round(F.max("n") / F.sum("n"), 6).alias("test_score"),
        F.round(F.sum("c") / 1000.0, 1).alias("dur"),
    )
    given = {
        "project": F.lit("baselines"), "name": F.col("source"), "clf": F.lit("majority"),
        "clf_full": F.concat(F.lit("majority("), "lang", F.lit(")")), "features": F.lit("label"),
        "train_data": F.array("source"), "train_data_path": F.array("source"), "test_data": F.array(F.lit("split")),
        "test_data_path": F.array().cast("array<string>"), "test_score": F.col("test_score"), "dur": F.col("dur"),
    }
    columns = [
        given.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in (f.strip().split(" ", 1) for f in _fields())
    ]
    registry = _registry(spark)
    registry.upsert("overview", found.select(*columns).withColumn("dur", F.lit(-1.0)))
    registry.upsert("overview", found.select(*columns))
    return registry


def _fields():
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(RECORD)]


@query(
    "SELECT project, name, data AS train_data, 'split' AS test_data, features, clf, dur, test_score"
    f" FROM ({_BASELINES})"
)
def registry_overview(spark, sf_dir):
    rows = _saved_baselines(spark, sf_dir).overview()
    return rows.withColumn("train_data", F.array_join("train_data", ",")).withColumn(
        "test_data", F.array_join("test_data", ",")
    )


@query(f"SELECT project, name, clf_full, test_score FROM ({_BASELINES}) WHERE name = 'src7'")
def registry_fetch(spark, sf_dir):
    """One record by name; reads one partition."""
    found = _saved_baselines(spark, sf_dir).fetch("name", "src7")
    return found.select("project", "name", "clf_full", "test_score")


@query(
    "SELECT name, unnest(['project name', 'experiment name', 'training data', 'testing data', 'features', 'classifier',"
    " 'duration', 'score on test']) AS title, unnest([project, name, data, '', features, clf_full, dur::VARCHAR,"
    f" test_score::VARCHAR]) AS value FROM ({_BASELINES})"
)
def config_view(spark, sf_dir):
    return _saved_baselines(spark, sf_dir).config_view()


@query(_BEST)
def stored_model(spark, sf_dir):
    """A model saved, loaded by name and put to work."""
    registry = _registry(spark)
    registry.save_model("language", _language_model(spark, sf_dir), ["char"])
    found = best_only(classify(_items(spark, sf_dir), registry.load_model("language"), [Ngrams("char", (3,))]))
    return found.withColumn("probability", F.round("probability", 6))


def _experiment(spark, sf_dir):
    config = ExperimentConfig(
        "roles", "demo", [Ngrams("text", (1,))], alphas=(0.5, 1.0), proportions=2, lime_docs=2, lime_samples=30,
        train_source=("conversations",),
    )
    return Experiment(config).run(role_docs(spark, sf_dir))


@query()
def experiment_record(spark, sf_dir):
    """A whole experiment on roles of turns, saved, and its stored record."""
    registry = _registry(spark)
    _experiment(spark, sf_dir).save(registry)
    return registry.fetch("name", "roles")


_ALPHAS = "0.5, 1.0"
TEST_PREDS = "SELECT * FROM preds WHERE split = 'test'"
_SUMMARY = (
    f"WITH {role_sql(_ALPHAS)}, folds AS (SELECT alpha, fold, f1_weighted AS f FROM ({averages_sql('SELECT * FROM preds WHERE fold >= 0', 'alpha, fold')})),"
    " chosen AS (SELECT alpha FROM folds GROUP BY alpha ORDER BY round(avg(f), 9) DESC, alpha DESC LIMIT 1),"
    f" tested AS (SELECT alpha, f1_weighted AS f FROM ({averages_sql(TEST_PREDS, 'alpha')})),"
    f" texts AS (SELECT list(text ORDER BY doc_id) AS t FROM (SELECT doc_id, text FROM ({ROLE_SQL}) ORDER BY doc_id LIMIT 2))"
    " SELECT 'demo' AS project, 'roles' AS name, 'MultinomialNB' AS clf, 'MultinomialNB(alpha=' || chosen.alpha::DECIMAL(3, 1) || ')' AS clf_full,"
    " ['conversations'] AS train_data, ['split'] AS test_data, t AS lime_data, t AS lime_data_repr, round(f, 6) AS test_score,"
    " 2::BIGINT AS n_explained FROM chosen JOIN tested USING (alpha), texts"
)


@query(_SUMMARY)
def experiment_summary(spark, sf_dir):
    """What the stored record of a whole experiment says, but for its duration and weights."""
    registry = _registry(spark)
    _experiment(spark, sf_dir).save(registry)
    return registry.fetch("name", "roles").select(
        "project", "name", "clf", "clf_full", "train_data", "test_data", "lime_data", "lime_data_repr",
        F.round("test_score", 6).alias("test_score"), F.size("lime_data_comp").cast("long").alias("n_explained"),
    )


@query()
def experiment_log(spark, sf_dir):
    return _experiment(spark, sf_dir).log()


# Explanations.

_SAMPLES = 3
_DROPPED = (
    "SELECT doc_id, sample, nr, w, CASE WHEN sample = 0 THEN true ELSE"
    " ('0x' || substr(md5('42:' || doc_id || ':' || sample || ':' || w), 1, 8))::BIGINT >="
    " ('0x' || substr(md5('42:' || doc_id || ':' || sample), 1, 8))::BIGINT END AS kept"
    " FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS nr FROM documents),"
    f" (SELECT unnest(range({_SAMPLES})) AS sample)"
)


@query(
    "SELECT doc_id, sample::INT AS sample, md5(coalesce(string_agg(w, ' ' ORDER BY nr) FILTER (WHERE kept), '')) AS text,"
    " count(DISTINCT w)::BIGINT AS n_words, (count(DISTINCT w) FILTER (WHERE kept))::DOUBLE AS n_kept"
    f" FROM ({_DROPPED}) GROUP BY doc_id, sample"
)
def word_dropout(spark, sf_dir):
    """Samples of every document with words left out."""
    drawn = explain.perturb(table(spark, sf_dir, "documents"), _SAMPLES)
    kept = F.aggregate("mask", F.lit(0.0), lambda acc, x: acc + x)
    return drawn.select(
        "doc_id", "sample", F.md5("text").alias("text"), F.size("words").cast("bigint").alias("n_words"), kept.alias("n_kept")
    )


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5")
def documents_to_explain(spark, sf_dir):
    return head_docs(table(spark, sf_dir, "documents").select("doc_id", "text"), 5)


def _explained(spark, sf_dir):
    """Explanations of the first documents by a model of quality."""
    docs = quality_docs(spark, sf_dir)
    words = Ngrams("text", (1,))
    model = naive_bayes.fit(words(by_document(docs), ["label"]), docs)
    chosen = head_docs(docs.select("doc_id", "text"), 5)
    return explain.explain(chosen, lambda texts: classify(texts, model, [words]), samples=60)


@query()
def word_weights(spark, sf_dir):
    return explain.weight_series(_explained(spark, sf_dir))


@query()
def top_label_weights(spark, sf_dir):
    return explain.choose_explanation(_explained(spark, sf_dir))


# The three words a document repeats most; every second one counts against.
_REPEATED = (
    "SELECT doc_id, w AS word, CASE WHEN r = 2 THEN -n ELSE n END AS weight, r FROM (SELECT doc_id, w, n::DOUBLE AS n,"
    " row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM (SELECT doc_id, w, count(*) AS n FROM"
    " (SELECT doc_id, unnest(string_split(replace(text, '\"', ''), ' ')) AS w FROM documents) GROUP BY doc_id, w)) WHERE r <= 3"
)


def _repeated(spark, sf_dir):
    docs = by_document(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select("doc_id", F.explode(F.split(F.replace("text", F.lit('"'), F.lit("")), " ")).alias("w"))
    counted = words.groupBy("doc_id", "w").agg(F.count("*").cast("double").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "w", "n")))
    top = counted.groupBy("doc_id").agg(F.slice(ordered, 1, 3).alias("top"))
    signed = F.transform(
        "top", lambda x, i: F.struct(x["w"].alias("word"), F.when(i == 1, -x["n"]).otherwise(x["n"]).alias("weight"))
    )
    return docs.join(top.select("doc_id", signed.alias("words")), "doc_id")


@query(
    "SELECT d.doc_id, string_agg(CASE WHEN e.weight IS NULL THEN d.w ELSE '<b><span style=\"color:' ||"
    " CASE WHEN e.weight < 0 THEN 'red' ELSE 'green' END || '\">' || d.w || '</span></b>' END, ' ' ORDER BY d.nr) AS text"
    " FROM (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS nr FROM (SELECT doc_id, string_split(replace(text, '\"', ''), ' ') AS x FROM documents)) d"
    f" LEFT JOIN ({_REPEATED}) e ON e.doc_id = d.doc_id AND e.word = d.w GROUP BY d.doc_id"
)
def highlight(spark, sf_dir):
    docs = _repeated(spark, sf_dir)
    return docs.select("doc_id", explain.highlight(F.col("text"), F.col("words")).alias("text"))


_LABELLED = (
    "SELECT r.doc_id, x.label, CASE WHEN x.label = d.lang THEN 0.4 WHEN x.label = 'none' THEN 0.4 ELSE 0.2 END AS probability,"
    f" r.word, r.weight FROM ({_REPEATED}) r JOIN documents d ON d.doc_id = r.doc_id,"
    " (SELECT unnest(['en', 'none', 'xx']) AS label) x"
)


def _labelled(spark, sf_dir):
    rows = _repeated(spark, sf_dir).select("doc_id", F.inline("words"))
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    spread = rows.join(langs, "doc_id").withColumn("label", F.explode(F.array(F.lit("en"), F.lit("none"), F.lit("xx"))))
    p = F.when((F.col("label") == F.col("lang")) | (F.col("label") == "none"), 0.4).otherwise(0.2)
    return spread.select("doc_id", "label", p.alias("probability"), "word", "weight")


@query(
    f"WITH e AS ({_LABELLED}) SELECT doc_id, label, probability::DOUBLE AS probability, word, weight, CASE WHEN weight < 0 THEN '-' ELSE '+' END AS sign"
    " FROM e WHERE label = 'none'"
)
def chosen_weights(spark, sf_dir):
    """Weights of the most probable label, the later name on equal ones."""
    chosen = explain.choose_explanation(_labelled(spark, sf_dir))
    signs = explain.weight_series(chosen)
    return signs.join(chosen.select("doc_id", "label", "word", "probability"), ["doc_id", "label", "word"])


@query(
    "SELECT DISTINCT doc_id, label, probability::DOUBLE AS probability, (dense_rank() OVER (PARTITION BY doc_id ORDER BY probability DESC, label DESC))::INT AS place"
    f" FROM ({_LABELLED})"
)
def probability_series(spark, sf_dir):
    return explain.class_probabilities(_labelled(spark, sf_dir))
