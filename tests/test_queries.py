"""Registered queries against their SQL on the smallest tables.

A few run here; ``check_queries.py`` runs all of them.
"""

import os

import pytest

from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
FEW = (
    "csv_by_name", "label_cap", "simple_clean", "social_clean", "annotated_tokens", "char_ngrams", "lexicon_sentiment",
    "text_stats", "token_stats", "merge_features", "vocabulary", "stratified_split", "nb_scores", "alpha_grid",
    "class_report", "roc_auc", "word_dropout", "highlight", "chain_sources", "chained_csv_words", "stat_groups",
    "embedding_mean", "tf_idf", "sparse_vectors", "gaussian_nb", "out_of_fold", "score_series", "config_view",
    "registry_fetch", "stored_model", "annotated_experiment", "learning_curve", "max_abs", "vectorize_holdout",
    "gaussian_out_of_fold", "classifier_search", "contest_of_equals", "separable_labels", "tf_idf_folds", "singular_values",
    "single_class_matrix", "experiment_summary",
)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", FEW)
def test_query(spark, name):
    good, note = compare(spark, connect(SF), SF, name)
    assert good, note


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chained_texts_are_hashed_before_they_are_taken_apart(spark, tmp_path):
    from lexigrid.catalog import QUERIES

    for name, id in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(1, "a b a"), (2, None)], f"{id} bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["chained_csv_words"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("md5(")  # the scan is printed last
    assert sorted((r["source"], r["token"], r["value"]) for r in found.collect()) == [
        (source, token, n) for source in ("benchmark", "documents") for token, n in (("a", 2.0), ("b", 1.0))
    ]
