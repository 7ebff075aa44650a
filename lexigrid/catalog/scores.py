"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.catalog.base import averages_sql, language_docs, quality_docs, query, report_sql, table
from lexigrid.catalog.models import _curve_part, quality_run, role_run, role_sql
from lexigrid.operators import metrics, naive_bayes, selection, splits
from lexigrid.session import staged


def _role_preds(spark, sf_dir):
    sides, rows = role_run(spark, sf_dir)
    preds = naive_bayes.out_of_fold(rows, sides, 5, keep=["label", "split"], train=F.col("split") == "train")
    return preds.select("split", "label", "predicted")


_PREDS = f"WITH {role_sql()} "
_TEST_PREDS = "SELECT * FROM preds WHERE split = 'test'"


def _rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query(
    _PREDS + ", l AS (SELECT DISTINCT split, x FROM (SELECT split, label AS x FROM preds UNION ALL SELECT split, predicted FROM preds))"
    " SELECT a.split, a.x AS label, b.x AS predicted, count(p.doc_id) AS n FROM l a JOIN l b ON a.split = b.split"
    " LEFT JOIN preds p ON p.split = a.split AND p.label = a.x AND p.predicted = b.x GROUP BY a.split, a.x, b.x"
)
def confusion(spark, sf_dir):
    return metrics.confusion(_role_preds(spark, sf_dir), ["split"])


@query(
    _PREDS + "SELECT label, count(*) FILTER (WHERE predicted = 'assistant') AS assistant,"
    " count(*) FILTER (WHERE predicted = 'system') AS system, count(*) FILTER (WHERE predicted = 'user') AS \"user\""
    " FROM preds GROUP BY label"
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_role_preds(spark, sf_dir), ["assistant", "system", "user"])


@query(
    _PREDS + "SELECT split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support"
    f" FROM ({report_sql('SELECT * FROM preds', 'split')})"
)
def class_report(spark, sf_dir):
    report = metrics.class_report(_role_preds(spark, sf_dir), ["split"]).drop("tp", "given")
    return _rounded(report, "precision", "recall", "f1")


@query(
    _PREDS + "SELECT split, round(f1_binary, 6) AS f1_binary, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,"
    f" round(f1_weighted, 6) AS f1_weighted FROM ({averages_sql('SELECT * FROM preds', 'split')})"
)
def f1_averages(spark, sf_dir):
    found = metrics.f1_averages(_role_preds(spark, sf_dir), ["split"]).drop("accuracy")
    return _rounded(found, "f1_binary", "f1_micro", "f1_macro", "f1_weighted")


@query(
    _PREDS + f", r AS ({report_sql('SELECT * FROM preds', 'split')})"
    " SELECT split, label, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1, support FROM r"
    " UNION ALL SELECT split, 'avg / total', round(sum(precision * support) / sum(support), 3), round(sum(recall * support) / sum(support), 3),"
    " round(sum(f1 * support) / sum(support), 3), sum(support)::BIGINT FROM r GROUP BY split"
)
def report_total(spark, sf_dir):
    return metrics.report_with_total(_role_preds(spark, sf_dir), ["split"])


@query(_PREDS + "SELECT split, round(avg((label = predicted)::INT), 6) AS accuracy FROM preds GROUP BY split")
def accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(_role_preds(spark, sf_dir), ["split"]), "accuracy")


@query(
    _PREDS + "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support,"
    f" round(f, 6) AS score FROM ({report_sql(_TEST_PREDS)}),"
    f" (SELECT f1_weighted AS f FROM ({averages_sql('SELECT * FROM preds', 'split')}) WHERE split = 'test')"
)
def held_out_score(spark, sf_dir):
    """The report of the test rows with their averaged score."""
    preds = staged(_role_preds(spark, sf_dir).where("split = 'test'"), "preds")
    report = _rounded(metrics.class_report(preds).drop("tp", "given"), "precision", "recall", "f1")
    score = metrics.averaged_f1(preds, "weighted").first()["score"]
    return _rounded(report.withColumn("score", F.lit(score)), "score")


@query(
    "WITH s AS (SELECT d.doc_id, l.quality = 1 AS pos, len(regexp_extract_all(text, '[!?.,:;()\"''\\-]+')) AS s"
    " FROM documents d JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT pos, (rank() OVER (ORDER BY s))"
    " + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS midrank FROM s)"
    " SELECT round((sum(midrank) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0)"
    " / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r"
)
def roc_auc(spark, sf_dir):
    """How well the number of punctuation marks tells good documents."""
    docs = quality_docs(spark, sf_dir)
    scored = docs.select("label", F.regexp_count("text", F.lit("[!?.,:;()\"'\\-]+")).alias("score"))
    return _rounded(metrics.roc_auc(scored, "score", F.col("label") == "1"), "auc")


@query(
    "SELECT label, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / sum(n) OVER (), 6) AS baseline"
    " FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang)"
)
def label_baseline(spark, sf_dir):
    return _rounded(metrics.label_distribution(language_docs(spark, sf_dir)), "share", "baseline")


@query(" UNION ALL ".join(_curve_part(p, 3) for p in (3, 2, 1)))
def score_series(spark, sf_dir):
    """Learning curve and final scores in one series."""
    sides, rows = quality_run(spark, sf_dir)
    curve = selection.learning_curve(rows, sides, 3).select("prop", "train", "test")
    fold = F.when(F.col("split") == "train", splits.fold_of(F.col("rank"), 5))
    preds = naive_bayes.out_of_fold(
        rows.withColumn("fold", fold), sides.withColumn("fold", fold), 5, keep=["label", "split"], train=F.col("split") == "train"
    )
    by_split = metrics.averaged_f1(preds, "weighted", ["split"])
    score = [F.max(F.when(F.col("split") == s, F.col("score"))).alias(s) for s in ("train", "test")]
    return _rounded(metrics.score_series(curve, by_split.agg(*score)), "train", "test")
