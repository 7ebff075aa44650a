"""Searches in which different classifiers compete."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid import fixed_values as V
from lexigrid.catalog import extraction  # noqa: F401  (its SQL is used here)
from lexigrid.catalog.base import (
    LANGUAGE_SQL, ORACLES, PREDICTED_SQL, ROLE_SQL, averages_sql, language_docs, nb_sql, query, ranks_sql, role_docs, split_sql, table,
)
from lexigrid.catalog.models import ROLE_FEATURES
from lexigrid.operators import estimators, gaussian, naive_bayes, splits
from lexigrid.operators.classifiers import GaussianBayes, LinearMachines, MultinomialBayes, Stages, TrainingSet, compete
from lexigrid.operators.features import Meta, Ngrams, SimpleStats, extract_features
from lexigrid.operators.ngrams import ngrams
from lexigrid.operators.placement import by_document
from lexigrid.plans.experiment import ExperimentConfig
from lexigrid.plans.search import Search
from lexigrid.session import new_path, staged
from lexigrid.sources.readers import read_docs
from lexigrid.sources.registry import Registry

# Text statistics of all documents with five folds.

_STATS = (*V.TEXT_STAT_NAMES, "n_chars")
_FOLDED = (
    f"sp AS MATERIALIZED (SELECT doc_id, label, (rank % 5)::INT AS fold FROM ({ranks_sql(LANGUAGE_SQL)})),"
    f" w AS (SELECT s.*, n_chars::DOUBLE AS n_chars FROM ({ORACLES['text_stats']}) s JOIN documents USING (doc_id)),"
    f" feats AS MATERIALIZED (SELECT doc_id, feature, round(value, 9) AS value FROM (UNPIVOT w ON {', '.join(_STATS)} INTO NAME feature VALUE value))"
)


def _folded(spark, sf_dir):
    docs = language_docs(spark, sf_dir)
    sides = staged(splits.stratified_folds(docs), "sides")
    sized = docs.drop("label").withColumn("n_chars", F.char_length("text").cast("double"))
    rows = extract_features(by_document(sized, sides), [SimpleStats(True, False, False), Meta(("n_chars",))], keep=["label", "fold"])
    rows = rows.withColumns({"feature": F.replace("feature", F.lit("meta_"), F.lit("")), "value": F.round("value", 9)})
    return staged(rows, "features"), sides


# Moments of the rows outside each fold, zeros included, taken anew from the rows.
_GAUSS = (
    "g_tr AS (SELECT k.fold AS without, f.feature, sp.label, f.value FROM feats f JOIN sp USING (doc_id),"
    " (SELECT unnest(range(5))::INT AS fold) k WHERE sp.fold <> k.fold),"
    " g_e AS (SELECT without, 1e-9 * max(v) AS e FROM (SELECT without, feature, var_pop(value) AS v FROM g_tr GROUP BY ALL) GROUP BY without),"
    " g_m AS (SELECT without, label, feature, avg(value) AS mu, var_pop(value) + any_value(e) AS var FROM g_tr JOIN g_e USING (without)"
    " GROUP BY without, label, feature),"
    " g_c AS (SELECT k.fold AS without, label, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY k.fold)) AS prior"
    " FROM sp, (SELECT unnest(range(5))::INT AS fold) k WHERE sp.fold <> k.fold GROUP BY k.fold, label),"
    " g_s AS (SELECT f.doc_id, m.label AS cls, any_value(prior) + sum(-0.5 * ln(2 * pi() * var) - pow(value - mu, 2) / (2 * var)) AS score"
    " FROM feats f JOIN sp USING (doc_id) JOIN g_m m ON m.without = sp.fold AND m.feature = f.feature"
    " JOIN g_c c ON c.without = sp.fold AND c.label = m.label GROUP BY f.doc_id, m.label)"
)


@query(f"WITH {_FOLDED}, {_GAUSS} SELECT doc_id, cls AS label, round(score, 3) AS score FROM g_s")
def gaussian_out_of_fold(spark, sf_dir):
    """Log scores of every document by Gaussian naive Bayes without its fold."""
    rows, sides = _folded(spark, sf_dir)
    scored, model = gaussian.cross_fit(rows, sides, 5)
    labels = F.array(*[F.lit(c) for c in model.classes])
    pairs = scored.select("doc_id", F.inline(F.arrays_zip(labels.alias("label"), F.col("scores").alias("score"))))
    return pairs.withColumn("score", F.round("score", 3))


_NB = nb_sql(
    "SELECT k.fold, sp.doc_id, sp.label FROM sp, (SELECT unnest(range(5))::INT AS fold) k WHERE sp.fold <> k.fold",
    "SELECT fold, doc_id FROM sp", "0.5, 1.0",
)
_F1 = averages_sql(
    "SELECT classifier, setting, fold, label, predicted FROM all_preds", "classifier, setting, fold"
)


@query(
    f"WITH {_FOLDED}, {_NB}, nb_best AS ({PREDICTED_SQL}), {_GAUSS},"
    " all_preds AS (SELECT 0 AS classifier, (alpha = 1.0)::INT AS setting, sp.fold, sp.label, b.predicted FROM nb_best b JOIN sp USING (doc_id)"
    " UNION ALL SELECT 1, 0, sp.fold, sp.label, g.predicted FROM (SELECT doc_id, arg_min(cls, (-round(score, 8), cls)) AS predicted"
    " FROM g_s GROUP BY doc_id) g JOIN sp USING (doc_id)),"
    f" m AS (SELECT classifier, setting, avg(f1_weighted) AS mean_score, stddev_pop(f1_weighted) AS std_score FROM ({_F1}) GROUP BY ALL)"
    " SELECT classifier::INT AS classifier, setting, ['MultinomialNB', 'GaussianNB'][classifier + 1] AS name,"
    " CASE WHEN classifier = 1 THEN 'var_smoothing=1e-09' ELSE 'alpha=' || ['0.5', '1.0'][setting + 1] END AS parameters,"
    " round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score, (rank() OVER (ORDER BY round(mean_score, 9) DESC))::INT AS rank FROM m"
)
def classifier_search(spark, sf_dir):
    """One grid over two kinds of naive Bayes: mean and spread over five folds, and the rank of every setting."""
    rows, sides = _folded(spark, sf_dir)
    found = compete(TrainingSet(rows, sides, 5), [MultinomialBayes((0.5, 1.0)), GaussianBayes()])
    return found.grid.withColumns({c: F.round(c, 6) for c in ("mean_score", "std_score")})


# Labels that one feature tells apart: whatever wins, its predictions are known.

_TOLD = "SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS label FROM documents"


def _told(spark, sf_dir):
    label = F.when(F.col("lang") == "en", "en").otherwise("other")
    docs = read_docs(table(spark, sf_dir, "documents").withColumn("label", label), "text", "label")
    return docs.withColumn("tongue", F.col("label"))


def _forest(**grid):
    return Stages([estimators.Pipe("clf", estimators.random_forest(10, 3), grid)])


@query(
    f"SELECT doc_id, label, split, label AS predicted, 'RandomForestClassifier(maxDepth=3)' AS winner, 6::BIGINT AS settings, 1.0::DOUBLE AS worst"
    f" FROM ({split_sql(_TOLD)})"
)
def contest_of_equals(spark, sf_dir):
    """Naive Bayes, Gaussian, linear machines and a forest with equal scores: the last one wins and predicts."""
    config = ExperimentConfig("equals", extractors=[Meta(("tongue",))], max_abs=True)
    classifiers = [MultinomialBayes((0.5, 1.0)), GaussianBayes(), LinearMachines((1.0,)), _forest(maxDepth=[2, 3])]
    run = Search(config, classifiers).run(_told(spark, sf_dir))
    worst = run.grid.agg(F.min("mean_score").alias("worst"), F.count("*").alias("settings")).first()
    return run.predictions.select(
        "doc_id", "label", "split", "predicted", F.lit(run.classifier).alias("winner"),
        F.lit(worst["settings"]).cast("long").alias("settings"), F.lit(worst["worst"]).alias("worst"),
    )


@query(f"SELECT doc_id, label AS machines, label AS calibrated, label AS stages, label AS forest FROM ({_TOLD})")
def separable_labels(spark, sf_dir):
    """Linear machines, their chances, the SVM of the stages and a forest on all documents."""
    docs = _told(spark, sf_dir)
    sides = staged(splits.stratified_folds(docs), "sides")
    rows = staged(Meta(("tongue",))(by_document(docs.drop("label"), sides), ["label", "fold"]), "features")
    data = TrainingSet(rows, sides, 5)
    model = LinearMachines((1.0,)).search(data).model(0).classify(rows, docs=sides)
    likely = F.get(F.map_keys("proba"), (F.array_position(F.map_values("proba"), F.array_max(F.map_values("proba"))) - 1).cast("int"))
    found = model.select("doc_id", F.col("predicted").alias("machines"), likely.alias("calibrated"))
    vectors = estimators.to_vectors(data.cells.drop("fold"), data.size, docs=data.train)
    for name, stage in (("stages", estimators.linear_svm(1.0, sides.count())), ("forest", estimators.random_forest(10, 3))):
        fitted = estimators.fit_labelled(stage, vectors).transform(vectors)
        found = found.join(fitted.select("doc_id", F.col("predicted").alias(name)), "doc_id")
    return found


_PENALTIES = tuple(round(10 ** (-2 + k / 3), 6) for k in range(10))  # ten from 0.01 to 10


def _marked(docs):
    """Texts that begin with a word that tells the label."""
    return docs.withColumn("text", F.concat(F.when(F.col("label") == "en", "alpha ").otherwise("beta "), F.col("text")))


def _machine_run(spark, sf_dir):
    docs = _marked(_told(spark, sf_dir).drop("tongue"))
    turns = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") == "user", "en").otherwise("other"))
    outside = _marked(read_docs(turns, "text", "label", id=F.col("conv_id") * 1000 + F.col("turn")))
    config = ExperimentConfig(
        "machines", "demo", [Ngrams("text", (1,))], cleaner=lambda text: F.regexp_extract(text, r"^\w+", 0), max_abs=True,
        proportions=2, lime_docs=2, train_source=("documents",), test_source=("conversations",),
    )
    return Search(config, [LinearMachines(_PENALTIES)]).run(docs, outside)


@query(
    "SELECT 'demo' AS project, 'machines' AS name, 'LinearSVM' AS clf, 'LinearSVM(C=10.0)' AS clf_full, 'documents' AS train_data,"
    " 'conversations' AS test_data, 1.0::DOUBLE AS test_score, x.texts AS lime_data, [] AS lime_data_path, x.texts AS lime_data_repr,"
    " [['en', 'other'], ['en', 'other']] AS classes, 1.0::DOUBLE AS curve, t.n AS n_test FROM"
    " (SELECT list(text ORDER BY doc_id) AS texts FROM (SELECT conv_id * 1000 + turn AS doc_id,"
    " CASE WHEN role = 'user' THEN 'alpha ' ELSE 'beta ' END || text AS text FROM conversations ORDER BY 1 LIMIT 2)) x,"
    " (SELECT count(*) AS n FROM conversations) t"
)
def machine_record(spark, sf_dir):
    """A whole run of linear machines (five folds, ten penalties, scaler by fold): external test set, curve, explanations, stored record."""
    run = _machine_run(spark, sf_dir)
    registry = Registry(spark, new_path(spark, "registry"))
    run.save(registry)
    row = registry.fetch("name", "machines")
    low = run.curve.agg(F.min(F.least("train", "test"))).first()[0]
    n_test = run.predictions.where("split = 'test' AND label = predicted").count()
    return row.select(
        "project", "name", "clf", "clf_full", F.get("train_data", F.lit(0)).alias("train_data"), F.get("test_data", F.lit(0)).alias("test_data"),
        "test_score", "lime_data", "lime_data_path", "lime_data_repr", F.transform("lime_data_comp.cln", lambda x: F.array_sort(x)).alias("classes"),
        F.lit(low).alias("curve"), F.lit(n_test).cast("long").alias("n_test"),
    )


# TF-IDF fitted without each fold: roles of turns by words.

_ROLE_FOLDS = (
    f"sp AS MATERIALIZED (SELECT doc_id, label, (rank % 5)::INT AS fold FROM ({ranks_sql(ROLE_SQL)})), feats AS MATERIALIZED ({ROLE_FEATURES}),"
    " k AS (SELECT unnest(range(5))::INT AS k),"
    " n AS (SELECT k, count(*)::DOUBLE AS n FROM sp, k WHERE fold <> k GROUP BY k),"
    " df AS (SELECT k, feature, count(*) FILTER (fold <> k AND value <> 0) AS df FROM feats JOIN sp USING (doc_id), k GROUP BY k, feature),"
    " w AS (SELECT df.k, f.doc_id, f.feature, f.value * (ln((1 + n) / (1 + df)) + 1) AS v FROM feats f JOIN df USING (feature) JOIN n ON n.k = df.k),"
    " wn AS MATERIALIZED (SELECT k, doc_id, feature, v / sqrt(sum(v * v) OVER (PARTITION BY k, doc_id)) AS value FROM w),"
    " sfc AS (SELECT k, label, feature, sum(value) AS s FROM wn JOIN sp USING (doc_id) WHERE fold <> k GROUP BY ALL),"
    " sc AS (SELECT k, label, sum(s) AS s FROM sfc GROUP BY ALL),"
    " cl AS (SELECT k, label, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY k)) AS prior FROM sp, k WHERE fold <> k GROUP BY k, label)"
)


@query(
    f"WITH {_ROLE_FOLDS} SELECT wn.doc_id, cl.label, round(any_value(prior) + sum(wn.value * ln((coalesce(sfc.s, 0) + 1) / (sc.s + v.v))), 5) AS score"
    " FROM wn JOIN sp ON sp.doc_id = wn.doc_id AND sp.fold = wn.k JOIN cl ON cl.k = wn.k JOIN sc ON sc.k = cl.k AND sc.label = cl.label"
    " LEFT JOIN sfc ON sfc.k = cl.k AND sfc.label = cl.label AND sfc.feature = wn.feature,"
    " (SELECT count(DISTINCT feature)::DOUBLE AS v FROM feats) v GROUP BY wn.doc_id, cl.label"
)
def tf_idf_folds(spark, sf_dir):
    """Log scores of every turn by naive Bayes on TF-IDF, both fitted without its fold."""
    docs = role_docs(spark, sf_dir)
    sides = staged(splits.stratified_folds(docs), "sides")
    rows = staged(ngrams(by_document(docs.drop("label"), sides), "text", (1,), keep=["label", "fold"]), "features")
    data = TrainingSet(rows, sides, 5, tf_idf=True)
    nested, model = naive_bayes.fit_weighted(data.weighted, sides, 5)
    scored = naive_bayes.score_parts(data.weighted.withColumn("value", F.get("values", F.col("fold"))), nested, fold="fold", docs=sides)
    labels = F.array(*[F.lit(c) for c in model.classes])
    pairs = scored.select("doc_id", F.inline(F.arrays_zip(labels.alias("label"), F.col("scores").alias("score"))))
    return pairs.withColumn("score", F.round("score", 5))
