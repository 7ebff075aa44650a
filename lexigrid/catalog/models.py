"""Splits, classifiers, model selection and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid import fixed_values as V
from lexigrid.catalog import extraction  # noqa: F401  (its SQL is used here)
from lexigrid.catalog.base import (
    ORACLES,
    CHARS, LANGUAGE_SQL, PREDICTED_SQL, QUALITY_SQL, ROLE_SQL, WORDS, averages_sql, counts_sql,
    language_docs, nb_sql, quality_docs, query, quotas_sql, ranks_sql, role_docs, split_sql, table,
)
from lexigrid.operators import estimators, gaussian, metrics, naive_bayes, selection, splits, vectorize
from lexigrid.operators.classifiers import LinearMachines
from lexigrid.operators.features import Meta, Ngrams, SimpleStats, extract_features
from lexigrid.operators.ngrams import gram_occurrences, ngrams
from lexigrid.operators.placement import by_document
from lexigrid.plans.estimator_experiment import EstimatorExperiment, load_estimators
from lexigrid.plans.experiment import ExperimentConfig
from lexigrid.plans.search import Search
from lexigrid.plans.serve import best_only, classify, classify_features, hard_labels, vectorize as vectorize_texts
from lexigrid.session import new_path, staged
from lexigrid.sources.readers import read_docs
from lexigrid.sources.registry import Registry
from lexigrid.streaming.classify import classify_stream

CHAR3 = Ngrams("char", (3,))
WORD1 = Ngrams("text", (1,))
_CHAR3 = counts_sql("SELECT doc_id, text FROM documents", "char", (3,), CHARS)


@query(split_sql(LANGUAGE_SQL))
def stratified_split(spark, sf_dir):
    return splits.stratified_split(language_docs(spark, sf_dir))


_FOLDS = f"SELECT doc_id, label, (rank % 5)::INT AS fold FROM ({ranks_sql(LANGUAGE_SQL)})"


@query(_FOLDS)
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(language_docs(spark, sf_dir))


_TRAIN = f"SELECT doc_id, label, rank FROM ({split_sql(LANGUAGE_SQL)}) WHERE split = 'train'"


@query(
    " UNION ALL ".join(
        f"SELECT {p}::INT AS part, t.doc_id, t.label FROM ({_TRAIN}) t JOIN ({quotas_sql(_TRAIN, f'{p} * n_all // 4')}) q"
        " ON t.label = q.label WHERE t.rank < q.quota"
        for p in (3, 2, 1)
    )
)
def training_subsets(spark, sf_dir):
    """Three quarters, half and a quarter of the training rows."""
    train = staged(splits.stratified_split(language_docs(spark, sf_dir)).where("split = 'train'"), "sides")
    parts = [
        splits.nested_subset(train, p, 4).select(F.lit(p).alias("part"), "doc_id", "label") for p in (3, 2, 1)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Naive Bayes on language: character trigrams, 30 per cent held out.


def _held_out(spark, sf_dir):
    """Feature rows of the test documents, and a model of the others.

    Training needs sums only, so grams go into them one by one; they are
    counted by document for the test rows alone.
    """
    sides = staged(splits.stratified_split(language_docs(spark, sf_dir)), "sides")
    docs = by_document(language_docs(spark, sf_dir).drop("label"), sides)
    grams = gram_occurrences(docs, "char", (3,), keep=["label", "split"]).withColumn("value", F.lit(1.0))
    model = naive_bayes.fit(grams, sides, train=F.col("split") == "train")
    return ngrams(docs.where("split = 'test'"), "char", (3,), keep=["label"]), model


_HELD_OUT = (
    f"sp AS ({split_sql(LANGUAGE_SQL)}), feats AS ({_CHAR3}), "
    + nb_sql("SELECT 0 AS fold, doc_id, label FROM sp WHERE split = 'train'", "SELECT 0 AS fold, doc_id FROM sp WHERE split = 'test'")
)


@query(
    f"WITH {_HELD_OUT} SELECT s.label, s.feature, round(ln((s.s + 1) / (sc.s + v)), 6) AS log_prob"
    " FROM sfc s JOIN sc ON sc.label = s.label CROSS JOIN vs"
)
def nb_weights(spark, sf_dir):
    """Log probabilities of the features each class has seen."""
    _, model = _held_out(spark, sf_dir)
    return model.weights().withColumn("log_prob", F.round("log_prob", 6))


@query(f"WITH {_HELD_OUT} SELECT doc_id, cls AS label, round(score, 4) AS score FROM scores")
def nb_scores(spark, sf_dir):
    """Joint log scores of held-out documents by class."""
    rows, model = _held_out(spark, sf_dir)
    scored = naive_bayes.score(rows, model)
    labels = F.array(*[F.lit(c) for c in model.classes])
    pairs = scored.select("doc_id", F.inline(F.arrays_zip(labels.alias("label"), F.col("scores").alias("score"))))
    return pairs.withColumn("score", F.round("score", 4))


@query(
    f"WITH {_HELD_OUT}, p AS (SELECT doc_id, alpha, arg_min(cls, (-round(score, 8), cls)) AS predicted FROM scores GROUP BY doc_id, alpha),"
    " x AS (SELECT sp.label, p.predicted FROM p JOIN sp ON sp.doc_id = p.doc_id)"
    " SELECT label, round(sum((label = predicted)::INT) / any_value(n), 6) AS recall, any_value(n) AS support"
    " FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM x) GROUP BY label"
)
def language_identification(spark, sf_dir):
    """The whole run: split, trigrams, training, held-out recall by language."""
    rows, model = _held_out(spark, sf_dir)
    preds = naive_bayes.score(rows, model, ["label"])
    report = metrics.class_report(preds)
    return report.select("label", F.round("recall", 6).alias("recall"), "support")


# Serving: a model on document language classifies benchmark items.


def _language_model(spark, sf_dir):
    docs = language_docs(spark, sf_dir)
    grams = gram_occurrences(by_document(docs), "char", (3,), keep=["label"])
    return naive_bayes.fit(grams.withColumn("value", F.lit(1.0)), docs)


def _items(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return read_docs(turns, "text", id=F.col("conv_id") * 1000 + F.col("turn"))


_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"
_SERVED = (
    f"dfeats AS ({_CHAR3}), ifeats AS ({counts_sql(_TURNS, 'char', (3,), CHARS)}),"
    " tr AS (SELECT doc_id, lang AS label FROM documents), vs AS (SELECT count(DISTINCT feature)::DOUBLE AS v FROM dfeats),"
    " cl AS (SELECT label, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM tr GROUP BY label),"
    " sfc AS (SELECT label, feature, sum(value) AS s FROM dfeats JOIN tr ON dfeats.doc_id = tr.doc_id GROUP BY label, feature),"
    " sc AS (SELECT label, sum(s) AS s FROM sfc GROUP BY label),"
    " known AS (SELECT * FROM ifeats WHERE feature IN (SELECT feature FROM dfeats)),"
    " scores AS (SELECT i.doc_id, cl.label AS cls, any_value(prior) + sum(i.value * ln((coalesce(w.s, 0) + 1) / (sc.s + v))) AS score"
    " FROM known i CROSS JOIN cl JOIN sc ON sc.label = cl.label CROSS JOIN vs"
    " LEFT JOIN sfc w ON w.label = cl.label AND w.feature = i.feature GROUP BY i.doc_id, cl.label),"
    " proba AS (SELECT doc_id, cls, exp(score - max(score) OVER d) / sum(exp(score - m)) OVER d AS p FROM"
    " (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM scores) WINDOW d AS (PARTITION BY doc_id))"
)
_BEST = (
    f"WITH {_SERVED} SELECT doc_id, arg_max(cls, p) AS predicted, round(max(p), 6) AS probability FROM proba GROUP BY doc_id"
)


@query(f"WITH {_SERVED} SELECT doc_id, cls AS label, round(p, 6) AS probability FROM proba")
def classify_probabilities(spark, sf_dir):
    found = classify(_items(spark, sf_dir), _language_model(spark, sf_dir), [CHAR3])
    return found.select("doc_id", F.explode("proba").alias("label", "probability")).withColumn(
        "probability", F.round("probability", 6)
    )


@query(_BEST)
def classify_best(spark, sf_dir):
    found = best_only(classify(_items(spark, sf_dir), _language_model(spark, sf_dir), [CHAR3]))
    return found.withColumn("probability", F.round("probability", 6))


@query(f"SELECT doc_id, predicted FROM ({_BEST})")
def classify_labels(spark, sf_dir):
    return hard_labels(classify(_items(spark, sf_dir), _language_model(spark, sf_dir), [CHAR3]))


@query(_BEST)
def classify_stored_features(spark, sf_dir):
    """Feature rows are stored by one job and classified by another."""
    rows = staged(vectorize_texts(_items(spark, sf_dir), [CHAR3]), "features")
    found = best_only(classify_features(rows, _language_model(spark, sf_dir)))
    return found.withColumn("probability", F.round("probability", 6))


@query(_BEST)
def classify_stream_of_texts(spark, sf_dir):
    """The same texts arriving as a stream of files."""
    model = _language_model(spark, sf_dir)
    folder = new_path(spark, "stream")
    # a pattern, so that the table may be one file or a folder of files
    arriving = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations.parque[t]")
    texts = read_docs(arriving, "text", id=F.col("conv_id") * 1000 + F.col("turn"))
    run = classify_stream(
        texts, lambda batch: best_only(classify(batch, model, [CHAR3])), f"{folder}/out", f"{folder}/state", once=True
    )
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out").drop("batch")
    return found.withColumn("probability", F.round("probability", 6))


@query(
    f"WITH f AS ({counts_sql(_TURNS, 'char', (3,), CHARS)}), v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx"
    f" FROM (SELECT DISTINCT feature FROM ({_CHAR3})))"
    " SELECT f.doc_id, v.idx, f.value FROM f JOIN v ON v.feature = f.feature"
)
def external_test_set(spark, sf_dir):
    """Another source in the vocabulary of the training data."""
    vocab = staged(vectorize.fit_vocabulary(CHAR3(by_document(language_docs(spark, sf_dir)))), "vocabulary")
    return vectorize.transform(CHAR3(by_document(_items(spark, sf_dir))), vocab)


# Gaussian naive Bayes on text statistics.

_GAUSS = (*V.TEXT_STAT_NAMES, "n_chars")


@query(
    f"WITH d AS (SELECT s.*, lang AS label, n_chars::DOUBLE AS n_chars FROM ({ORACLES['text_stats']}) s"
    " JOIN documents USING (doc_id)),"
    f" x AS (UNPIVOT d ON {', '.join(_GAUSS)} INTO NAME feature VALUE value),"
    " e AS (SELECT 1e-9 * max(var) AS e FROM (SELECT var_pop(value) AS var FROM x GROUP BY feature)),"
    " m AS (SELECT label, feature, avg(value) AS mu, var_pop(value) + any_value(e) AS var FROM x, e GROUP BY label, feature),"
    " c AS (SELECT label, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS prior FROM d GROUP BY label)"
    " SELECT x.doc_id, m.label, round(any_value(prior) + sum(-0.5 * ln(2 * pi() * var) - pow(value - mu, 2) / (2 * var)), 4) AS score"
    " FROM x JOIN m ON m.feature = x.feature JOIN c ON c.label = m.label GROUP BY x.doc_id, m.label"
)
def gaussian_nb(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("label", F.col("lang"))
    rows = extract_features(docs, [SimpleStats(True, False, False), Meta(("n_chars",))], keep=["label"])
    rows = rows.withColumn("feature", F.replace("feature", F.lit("meta_"), F.lit("")))
    rows = staged(rows.withColumn("value", F.round("value", 9)), "features")
    model = gaussian.fit(rows, docs)
    scored = gaussian.score(rows, model, docs=docs)
    labels = F.array(*[F.lit(c) for c in model.classes])
    pairs = scored.select("doc_id", F.inline(F.arrays_zip(labels.alias("label"), F.col("scores").alias("score"))))
    return pairs.withColumn("score", F.round("score", 4))


# Estimators of pyspark.ml on statistics of all documents.


def _stat_vectors(spark, sf_dir):
    docs = language_docs(spark, sf_dir)
    folds = splits.stratified_folds(docs)
    rows = staged(SimpleStats(True, False, False)(by_document(docs.drop("label"), folds), ["label", "fold"]), "features")
    maxima = staged(vectorize.fit_max_abs(rows), "maxima")
    rows = vectorize.scale_max_abs(rows, maxima)
    vocab = staged(vectorize.fit_vocabulary(rows), "vocabulary")
    cells = vectorize.transform(rows, vocab, ["label", "fold"])
    return staged(estimators.to_vectors(cells, len(V.TEXT_STAT_NAMES), ["label", "fold"]), "vectors")


@query()
def linear_svm(spark, sf_dir):
    """A linear SVM with probabilities, on scaled text statistics."""
    vectors = _stat_vectors(spark, sf_dir)
    model = estimators.fit_labelled(estimators.linear_svm(1.0, vectors.count()), vectors)
    return model.transform(vectors).select("doc_id", "label", "predicted")


@query()
def random_forest(spark, sf_dir):
    vectors = _stat_vectors(spark, sf_dir)
    model = estimators.fit_labelled(estimators.random_forest(20, 6), vectors)
    return model.transform(vectors).select("doc_id", "label", "predicted")


@query()
def estimator_grid(spark, sf_dir):
    """Grid search of pipeline stages over given folds."""
    vectors = _stat_vectors(spark, sf_dir)
    vectors = staged(estimators.label_indexer().fit(vectors).transform(vectors), "vectors")
    forest = estimators.Pipe("clf", estimators.random_forest(10, 4), {"maxDepth": [2, 5]})
    found = estimators.cross_validate([forest], vectors, 5)
    rows = estimators.grid_scores(found)
    return spark.createDataFrame(rows, "classifier int, setting int, parameters string, mean_score double")


@query()
def svm_experiment(spark, sf_dir):
    """A whole experiment with a scaler, five folds and ten penalties of a linear SVM."""
    penalties = tuple(round(10 ** (-2 + k / 3), 6) for k in range(10))
    config = ExperimentConfig("svm", extractors=[SimpleStats(True, False, False)], max_abs=True)
    return Search(config, [LinearMachines(penalties)]).run(language_docs(spark, sf_dir)).report


@query("SELECT doc_id, true AS same FROM documents")
def stored_stages(spark, sf_dir):
    """A stage experiment saved, loaded by name, and compared with itself on all documents."""
    docs = language_docs(spark, sf_dir)
    forest = estimators.Pipe("clf", estimators.random_forest(10, 4))
    config = ExperimentConfig("007", extractors=[SimpleStats(True, False, False)], max_abs=True, cv=2)
    run = EstimatorExperiment(config, [forest]).run(docs)
    registry = Registry(spark, new_path(spark, "registry"))
    run.save(registry)
    again = load_estimators(registry, config).classify(docs).select("doc_id", F.col("predicted").alias("again"))
    return run.classify(docs).join(again, "doc_id").select("doc_id", (F.col("predicted") == F.col("again")).alias("same"))


# Model selection: word counts, quality of documents and roles of turns.


def role_run(spark, sf_dir):
    """Turns split and folded, with word counts."""
    docs = role_docs(spark, sf_dir)
    sides = splits.stratified_split(docs)
    fold = F.when(F.col("split") == "train", splits.fold_of(F.col("rank"), 5))
    sides = staged(sides.withColumn("fold", fold), "sides")
    rows = ngrams(by_document(docs.drop("label"), sides), "text", (1,), keep=["label", "split", "fold"])
    return sides, staged(rows, "features")


ROLE_FEATURES = counts_sql(f"SELECT doc_id, text FROM ({ROLE_SQL})", "text", (1,), WORDS)
ROLE_SIDES = f"SELECT *, CASE WHEN split = 'train' THEN rank % 5 ELSE -1 END AS fold FROM ({split_sql(ROLE_SQL)})"


def role_sql(alphas: str = "1.0") -> str:
    """Out-of-fold predictions of training rows and predictions of test rows."""
    train = (
        "SELECT k.fold, sp.doc_id, sp.label FROM sp, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold) k"
        " WHERE sp.split = 'train' AND sp.fold <> k.fold"
    )
    return (
        f"sp AS ({ROLE_SIDES}), feats AS ({ROLE_FEATURES}), {nb_sql(train, 'SELECT fold, doc_id FROM sp', alphas)},"
        f" best AS ({PREDICTED_SQL}), preds AS (SELECT sp.doc_id, sp.label, sp.split, sp.fold, best.alpha, best.predicted"
        " FROM best JOIN sp ON sp.doc_id = best.doc_id)"
    )


@query(f"WITH {role_sql()} SELECT doc_id, label, split, predicted FROM preds")
def out_of_fold(spark, sf_dir):
    """Training rows predicted without their fold, test rows by all of them."""
    sides, rows = role_run(spark, sf_dir)
    preds = naive_bayes.out_of_fold(rows, sides, 5, keep=["label", "split"], train=F.col("split") == "train")
    return preds.select("doc_id", "label", "split", "predicted")


ALPHAS = (0.1, 0.5, 1.0, 2.0)
_GRID = (
    f"WITH {role_sql('0.1, 0.5, 1.0, 2.0')}, g AS (SELECT alpha, fold, f1_weighted AS score FROM"
    f" ({averages_sql('SELECT * FROM preds WHERE fold >= 0', 'alpha, fold')}))"
)


def _grid_scores(spark, sf_dir):
    sides, rows = role_run(spark, sf_dir)
    train = rows.where("split = 'train'")
    return selection.naive_bayes_grid(train, sides.where("split = 'train'"), ALPHAS)


_GRID_TRAIN = _GRID.replace(
    "vs AS (SELECT count(DISTINCT feature)::DOUBLE AS v FROM feats)",
    "vs AS (SELECT count(DISTINCT feature)::DOUBLE AS v FROM feats JOIN sp ON sp.doc_id = feats.doc_id WHERE sp.split = 'train')",
)


@query(f"{_GRID_TRAIN} SELECT alpha, fold::INT AS fold, round(score, 6) AS score FROM g")
def alpha_grid(spark, sf_dir):
    """The score of every smoothing value on every fold."""
    return _grid_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    f"{_GRID_TRAIN} SELECT alpha, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score,"
    " (rank() OVER (ORDER BY round(mean_score, 9) DESC))::INT AS rank"
    " FROM (SELECT alpha, avg(score) AS mean_score, stddev_pop(score) AS std_score FROM g GROUP BY alpha)"
)
def grid_report(spark, sf_dir):
    report = selection.grid_report(_grid_scores(spark, sf_dir))
    return report.withColumn("mean_score", F.round("mean_score", 6)).withColumn("std_score", F.round("std_score", 6))


@query(
    f"{_GRID_TRAIN} SELECT alpha, round(mean_score, 6) AS mean_score FROM"
    " (SELECT alpha, avg(score) AS mean_score FROM g GROUP BY alpha) ORDER BY mean_score DESC, alpha DESC LIMIT 1"
)
def best_alpha(spark, sf_dir):
    report = selection.grid_report(_grid_scores(spark, sf_dir))
    return selection.best_model(report, order="alpha").select("alpha", F.round("mean_score", 6).alias("mean_score"))


# Learning curve on document quality.


def _curve_part(p: int, parts: int) -> str:
    """``prop, train, test`` when training on the first ``p`` of ``parts``."""
    train = f"SELECT doc_id, label, rank FROM ({split_sql(QUALITY_SQL)}) WHERE split = 'train'"
    subset = (
        f"SELECT t.doc_id, t.label, t.rank % 5 AS fold FROM ({train}) t"
        f" JOIN ({quotas_sql(train, f'{p} * n_all // {parts}')}) q ON t.label = q.label WHERE t.rank < q.quota"
    )
    feats = counts_sql(f"SELECT doc_id, text FROM ({QUALITY_SQL})", "text", (1,), WORDS)
    rows = (
        "SELECT k.fold, su.doc_id, su.label FROM su, (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS fold) k WHERE su.fold <> k.fold"
    )
    ask = f"SELECT fold, doc_id FROM su UNION ALL SELECT -1, doc_id FROM ({split_sql(QUALITY_SQL)}) WHERE split = 'test'"
    sides = f"SELECT doc_id, label, split FROM ({split_sql(QUALITY_SQL)})"
    return (
        f"SELECT {p} / {parts}::DOUBLE AS prop, round(max(f1_weighted) FILTER (WHERE split = 'train'), 6) AS train,"
        " round(max(f1_weighted) FILTER (WHERE split = 'test'), 6) AS test FROM ("
        f"WITH su AS ({subset}), feats AS ({feats}), {nb_sql(rows, ask)}, best AS ({PREDICTED_SQL}),"
        f" preds AS (SELECT s.label, s.split, best.predicted FROM best JOIN ({sides}) s ON s.doc_id = best.doc_id)"
        f" {averages_sql('SELECT * FROM preds', 'split')})"
    )


def quality_run(spark, sf_dir):
    docs = quality_docs(spark, sf_dir)
    sides = staged(splits.stratified_split(docs), "sides")
    rows = ngrams(by_document(docs.drop("label"), sides), "text", (1,), keep=["label", "split", "rank"])
    return sides, staged(rows, "features")


@query(" UNION ALL ".join(_curve_part(p, 3) for p in (2, 1)))
def learning_curve(spark, sf_dir):
    """Scores when training on two thirds and on one third of the rows."""
    sides, rows = quality_run(spark, sf_dir)
    curve = selection.learning_curve(rows, sides, 3)
    return curve.select("prop", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"))
