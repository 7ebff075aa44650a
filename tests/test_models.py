import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import estimators, gaussian, metrics, naive_bayes, selection, splits, svd, vectorize
from lexigrid.operators.naive_bayes import softmax
from lexigrid.operators.ngrams import ngrams
from lexigrid.session import staged


def words(docs, keep=("label",)):
    return ngrams(docs, "text", (1,), keep=list(keep))


def brute(docs, train, test, alpha=1.0, vocab_of=None):
    """Multinomial naive Bayes in plain Python; texts by id."""
    feats = {i: Counter([""] + t.split(" ") + [""]) for i, (t, _) in docs.items()}
    vocab = {w for i in (vocab_of or docs) for w in feats[i]}
    sums, n = defaultdict(Counter), Counter()
    for i in train:
        n[docs[i][1]] += 1
        sums[docs[i][1]].update(feats[i])
    out = {}
    for i in test:
        row = []
        for c in sorted(n):
            total = sum(sums[c].values())
            s = math.log(n[c] / len(train))
            for w, v in feats[i].items():
                if w in vocab:
                    s += v * math.log((sums[c][w] + alpha) / (total + alpha * len(vocab)))
            row.append(s)
        out[i] = row
    return out


def by_id(df):
    return {r["doc_id"]: (r["text"], r["label"]) for r in df.collect()}


def scores_of(df):
    return {r["doc_id"]: list(r["scores"]) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-8)


def test_prior_is_not_smoothed(spark):
    rows = spark.createDataFrame(
        [(0, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3, "a", "y")], "doc_id bigint, text string, label string"
    )
    model = naive_bayes.fit(words(rows), rows)
    assert [math.exp(p) for p in model.log_priors()] == pytest.approx([0.75, 0.25])


@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_scores_equal_brute_force(spark, docs, alpha):
    side = docs.withColumn("train", F.col("doc_id") % 4 != 0)
    rows = words(side, ["label", "train"])
    model = naive_bayes.fit(rows, side, alpha, F.col("train"))
    got = scores_of(naive_bayes.score(rows.where(~F.col("train")), model))
    table = by_id(docs)
    train = [i for i in table if i % 4]
    same(got, brute(table, train, [i for i in table if i % 4 == 0], alpha))


def test_unknown_words_do_not_count(spark, docs):
    model = naive_bayes.fit(words(docs), docs)
    other = spark.createDataFrame([(1, "nice unheard nice", "pos")], "doc_id bigint, text string, label string")
    table = {**{i: d for i, d in by_id(docs).items()}, 1000: ("nice unheard nice", "pos")}
    expected = brute(table, [i for i in table if i != 1000], [1000], vocab_of=[i for i in table if i != 1000])
    assert scores_of(naive_bayes.score(words(other), model))[1] == pytest.approx(expected[1000], abs=1e-8)


def test_out_of_fold_equals_training_again(spark, docs):
    side = docs.withColumn("fold", F.when(F.col("doc_id") < 32, F.expr("cast((doc_id div 3) % 3 AS int)")))
    rows = words(side, ["label", "fold"])
    train = F.col("fold").isNotNull()
    got = scores_of(naive_bayes.out_of_fold(rows, side, 3, train=train))
    table = by_id(docs)
    expected = {}
    for f in range(3):
        expected.update(brute(table, [i for i in table if i < 32 and i // 3 % 3 != f], [i for i in table if i < 32 and i // 3 % 3 == f]))
    expected.update(brute(table, [i for i in table if i < 32], [i for i in table if i >= 32]))
    same(got, expected)


def test_a_model_with_folds_is_also_the_model_of_all(spark, docs):
    side = docs.withColumn("fold", F.expr("cast((doc_id div 3) % 3 AS int)"))
    rows = words(side, ["label", "fold"])
    folded = naive_bayes.fit(rows, side, folds=3)
    plain = scores_of(naive_bayes.score(words(docs), naive_bayes.fit(words(docs), docs)))
    same(scores_of(naive_bayes.score(words(docs), folded)), plain)
    same(scores_of(naive_bayes.score(words(docs), folded.merged())), plain)
    weights = {(r["label"], r["feature"]): r["log_prob"] for r in folded.weights().collect()}
    again = {(r["label"], r["feature"]): r["log_prob"] for r in folded.merged().weights().collect()}
    assert weights == pytest.approx(again) and ("pos", "text-good") in weights and ("neg", "text-good") not in weights


def test_many_classes_and_folds(spark):
    rows = [(i, f"w{i % 20} w{i % 4}", f"c{i % 20:02}", i // 20 % 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, fold int")
    got = scores_of(naive_bayes.out_of_fold(words(docs, ["label", "fold"]), docs, 5))
    table = by_id(docs)
    expected = {}
    for f in range(5):
        expected.update(brute(table, [i for i in table if rows[i][3] != f], [i for i in table if rows[i][3] == f]))
    same(got, expected)


def test_documents_without_features_are_scored(spark):
    rows = [(i, "good day" if i % 3 == 0 else "bad day" if i % 3 == 1 else "", "abc"[i % 3], i // 3 % 4) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string, fold int")
    feats = words(docs, ["label", "fold"]).where("doc_id % 3 <> 2")
    found = naive_bayes.out_of_fold(feats, docs, 4, keep=["label"]).collect()
    assert len(found) == 60
    predicted = {r["doc_id"]: r["predicted"] for r in found}
    assert all(predicted[i] == "ab"[i % 3] for i in range(60) if i % 3 < 2)
    shares = [math.log(1 / 3)] * 3
    assert all(r["scores"] == pytest.approx(shares) for r in found if r["doc_id"] % 3 == 2)
    report = {r["label"]: r["support"] for r in metrics.class_report(naive_bayes.out_of_fold(feats, docs, 4, keep=["label"])).collect()}
    assert report == {"a": 20, "b": 20, "c": 20}


def test_scaler_is_refitted_in_every_fold(spark, docs):
    side = docs.withColumn("fold", F.when(F.col("doc_id") < 32, F.expr("cast((doc_id div 3) % 3 AS int)")))
    rows = staged(words(side, ["label", "fold"]), "rows")
    train = F.col("fold").isNotNull()
    scored, model = naive_bayes.cross_fit(rows, side, 3, train=train, max_abs=True)
    got = scores_of(scored)
    everything = rows.select("feature").distinct()
    for f in (0, 1, 2, None):
        inside = train if f is None else train & (F.col("fold") != f)
        asked = F.col("fold").isNull() if f is None else F.col("fold") == f
        maxima = everything.join(vectorize.fit_max_abs(rows.where(inside)), "feature", "left").fillna(0.0)
        scaled = vectorize.scale_max_abs(rows, staged(maxima, "maxima"))
        plain = naive_bayes.fit(scaled, side, train=F.coalesce(inside, F.lit(False)))
        want = scores_of(naive_bayes.score(scaled.where(asked), plain))
        same({i: got[i] for i in want}, want)
        if f is None:
            same(scores_of(naive_bayes.score(scaled.where(asked), model.merged())), want)


def test_rows_without_a_label_are_not_learned_from(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(900, "good bad", None)], "doc_id bigint, text string, label string"))
    assert naive_bayes.fit(words(more, ["label"]), more).classes == ("neg", "pos")


def test_gaussian_keeps_the_variance_of_large_values(spark):
    rows = [(i, "stamp", 1.7e9 + (i % 2) * 10 + i / 100, "xy"[i % 2]) for i in range(100)]
    feats = spark.createDataFrame(rows, "doc_id bigint, feature string, value double, label string")
    labels = feats.select("doc_id", "label")
    more = labels.unionByName(spark.createDataFrame([(500, "x")], "doc_id bigint, label string"))
    model = gaussian.fit(feats, labels)
    got = {r["doc_id"]: r["predicted"] for r in gaussian.score(feats, model, docs=more).collect()}
    assert len(got) == 101 and all(got[i] == "xy"[i % 2] for i in range(100))
    with pytest.raises(ValueError, match="varies"):
        gaussian.fit(feats.withColumn("value", F.lit(0.0)), labels)


def test_probabilities_sum_to_one(spark):
    row = spark.range(1).select(softmax(F.array(F.lit(-1000.0), F.lit(-1001.0))).alias("p")).first()["p"]
    assert sum(row) == pytest.approx(1) and row[0] == pytest.approx(1 / (1 + math.exp(-1)))


def test_gaussian_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(2.0, (60, 3)) * (rng.random((60, 3)) < 0.7)
    y = np.array(["a", "b", "c"])[rng.integers(0, 3, 60)]
    rows = [(i, f"f{j}", float(v), str(y[i])) for i in range(60) for j, v in enumerate(x[i]) if v]
    feats = spark.createDataFrame(rows, "doc_id bigint, feature string, value double, label string")
    labels = spark.createDataFrame([(i, str(c)) for i, c in enumerate(y)], "doc_id bigint, label string")
    got = scores_of(gaussian.score(feats, gaussian.fit(feats, labels)))
    eps = 1e-9 * x.var(axis=0).max()
    for i, row in got.items():
        for k, c in enumerate(sorted(set(y))):
            mu, var = x[y == c].mean(axis=0), x[y == c].var(axis=0) + eps
            expected = math.log((y == c).mean()) + (-0.5 * np.log(2 * np.pi * var) - (x[i] - mu) ** 2 / (2 * var)).sum()
            assert row[k] == pytest.approx(expected, abs=1e-6)


GOLD = [("DF", "DF")] * 5 + [("DF", "ML")] * 5 + [("ML", "DF")] * 1 + [("ML", "ML")] * 9


def test_metrics_on_the_known_matrix(spark):
    preds = spark.createDataFrame(GOLD, "label string, predicted string")
    report = {r["label"]: r for r in metrics.class_report(preds).collect()}
    assert report["DF"]["precision"] == pytest.approx(5 / 6) and report["ML"]["precision"] == pytest.approx(9 / 14)
    assert report["DF"]["recall"] == 0.5 and report["ML"]["recall"] == 0.9
    assert report["DF"]["f1"] == pytest.approx(0.625)
    av = metrics.f1_averages(preds).first()
    assert av["f1_weighted"] == pytest.approx(0.6875) and av["accuracy"] == pytest.approx(0.7)
    assert av["f1_binary"] == pytest.approx(0.75) and av["f1_micro"] == pytest.approx(0.7)
    total = metrics.report_with_total(preds, digits=2).where("label = 'avg / total'").first()
    assert (total["precision"], total["recall"], total["f1"], total["support"]) == (0.74, 0.7, 0.69, 20)
    grid = {(r["label"], r["predicted"]): r["n"] for r in metrics.confusion(preds).collect()}
    assert grid == {("DF", "DF"): 5, ("DF", "ML"): 5, ("ML", "DF"): 1, ("ML", "ML"): 9}


def test_missing_cells_and_divisions_are_zero(spark):
    preds = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    grid = {(r["label"], r["predicted"]): r["n"] for r in metrics.confusion(preds).collect()}
    assert len(grid) == 9 and grid[("b", "a")] == 0
    report = {r["label"]: r for r in metrics.class_report(preds).collect()}
    assert report["a"]["precision"] == 0 and report["a"]["f1"] == 0
    with pytest.raises(ValueError):
        metrics.averaged_f1(preds, "samples")


def test_auc_with_ties_equals_all_pairs(spark):
    rows = [(i % 5 + (i % 3), i % 3 == 0) for i in range(90)]
    df = spark.createDataFrame(rows, "s int, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    expected = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "s", F.col("y")).first()["auc"] == pytest.approx(expected)
    assert metrics.roc_auc(df.where("y"), "s", F.col("y")).first()["auc"] is None


def test_selection_tables(spark):
    scores = spark.createDataFrame([("a", 0.5, 1), ("b", 0.7, 2), ("c", 0.7, 3)], "clf string, mean_score double, ord int")
    assert selection.best_model(scores).first()["clf"] == "c"
    grid = selection.parameter_grid({"svd": {"k": [1, 2]}, "clf": {"C": [0.1]}})
    assert grid == [{"svd__k": 1, "clf__C": 0.1}, {"svd__k": 2, "clf__C": 0.1}]
    curve = spark.createDataFrame([(0.5, 0.6, None), (0.25, 0.4, 0.3)], "prop double, train double, test double")
    final = spark.createDataFrame([(0.8, 0.7)], "train double, test double")
    assert [tuple(r) for r in metrics.score_series(curve, final).collect()] == [(0.25, 0.4, 0.3), (0.5, 0.6, 0.0), (1.0, 0.8, 0.7)]


def test_svm_and_vectors(spark, docs):
    rows = staged(words(docs))
    vocab = staged(vectorize.fit_vocabulary(rows))
    cells = staged(vectorize.transform(rows, vocab, ["label"]))
    n = vocab.count()
    vectors = staged(estimators.to_vectors(cells, n, ["label"]))
    model = estimators.fit_labelled(estimators.linear_svm(1.0, 40, max_iter=10), vectors)
    found = model.transform(vectors).collect()
    assert all(r["label"] == r["predicted"] for r in found)
    assert all(sum(r["probability"]) == pytest.approx(1) for r in found)


@pytest.mark.parametrize("join", [{}, {"broadcast_bytes": 0}])
def test_svd_equals_numpy(spark, join):
    rng = np.random.default_rng(5)
    matrix = rng.poisson(0.4, (60, 25)).astype(float)
    matrix[:, 0] += np.arange(60) % 5
    rows = [(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    cells = spark.createDataFrame(rows, "doc_id bigint, idx bigint, value double")
    model = svd.fit(cells, 2, iterations=4, **join)
    u, s, vt = np.linalg.svd(matrix)
    assert list(model.singular_values) == pytest.approx(list(s[:2]), rel=1e-3)
    reduced = {r["doc_id"]: r["v0"] for r in svd.project(cells, model, **join).collect()}
    expected = matrix @ vt[0]
    for i, v in reduced.items():
        assert abs(v) == pytest.approx(abs(expected[i]), abs=0.05)


def test_svd_of_many_components(spark):
    """A hundred components are one list, not thousands of columns."""
    rng = np.random.default_rng(7)
    matrix = rng.poisson(0.5, (150, 130)) * rng.random((150, 130)) * np.linspace(3, 0.2, 130)
    rows = [(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    cells = staged(spark.createDataFrame(rows, "doc_id bigint, idx bigint, value double"), "cells")
    model = svd.fit(cells, 100, iterations=3)
    s = np.linalg.svd(matrix, compute_uv=False)
    assert list(model.singular_values[:60]) == pytest.approx(list(s[:60]), rel=1e-2)
    assert len(svd.project(cells, model).columns) == 101


def test_vectors_hold_unseen_columns_as_zeros(spark):
    cells = spark.createDataFrame([(1, 4, 2.0), (1, 0, 1.0)], "doc_id bigint, idx bigint, value double")
    v = estimators.to_vectors(cells, 7).first()["features"]
    assert v.size == 7 and list(v.indices) == [0, 4] and list(v.values) == [1.0, 2.0]


def test_learning_curve_trains_on_what_it_says(spark, docs):
    sides = staged(splits.stratified_split(docs))
    rows = staged(words(docs.drop("label").join(sides, "doc_id"), ["label", "split", "rank"]))
    curve = {round(r["prop"], 2): r for r in selection.learning_curve(rows, sides, 2, folds=2).collect()}
    assert list(curve) == [0.5]
    subset = {r["doc_id"]: r for r in splits.nested_subset(sides.where("split = 'train'"), 1, 2).collect()}
    table = by_id(docs)
    test = [r["doc_id"] for r in sides.where("split = 'test'").collect()]
    raw = brute(table, list(subset), test)
    preds = [(table[i][1], ["neg", "pos"][int(np.argmax(s))]) for i, s in raw.items()]
    expected = metrics.averaged_f1(spark.createDataFrame(preds, "label string, predicted string"), "weighted").first()["score"]
    assert curve[0.5]["test"] == pytest.approx(expected)


@pytest.mark.parametrize("max_abs", [False, True])
def test_curve_from_one_table_of_sums(spark, docs, max_abs, monkeypatch):
    """Every part scored as if it had been trained by itself; classes in blocks or in one row."""
    sides = staged(splits.stratified_split(docs, seed=3), "sides")
    rows = staged(words(docs.drop("label").join(sides, "doc_id"), ["label", "split", "rank"]), "features")
    got = {round(r["prop"], 2): r for r in selection.learning_curve(rows, sides, 4, 3, (0.1, 1.0), max_abs=max_abs).collect()}
    assert sorted(got) == [0.25, 0.5, 0.75]
    for part in (1, 2, 3):
        inside = splits.nested_subset(sides.where("split = 'train'"), part, 4)
        fold = F.when(F.col("_in"), splits.fold_of(F.col("rank"), 3))
        marks = inside.select("doc_id", F.lit(True).alias("_in"))
        side = staged(sides.join(marks, "doc_id", "left").fillna(False, ["_in"]).withColumn("fold", fold), "side")
        feats = rows.join(side.select("doc_id", "_in", "fold"), "doc_id")
        preds = naive_bayes.out_of_fold(
            feats, side, 3, (0.1, 1.0), ["label", "split"], F.col("_in"), (F.col("split") == "test") | F.col("_in"), max_abs
        )
        scores = metrics.averaged_f1(preds, "weighted", ["alpha", "split"]).collect()
        best = max((r["score"], r["alpha"]) for r in scores if r["split"] == "train")
        want = next(r["score"] for r in scores if r["split"] == "test" and r["alpha"] == best[1])
        found = got[part / 4]
        assert (found["train"], found["alpha"], found["test"]) == pytest.approx((*best, want))
    whole = scores_of(naive_bayes.score(rows, naive_bayes.fit(rows, sides, folds=1), alphas=(0.5,)))
    monkeypatch.setattr(naive_bayes, "_COLUMNS", 1)
    blocks = scores_of(naive_bayes.score(rows, naive_bayes.fit(rows, sides, folds=1), alphas=(0.5,)))
    for id, scores in whole.items():
        assert blocks[id] == pytest.approx(scores)


def test_scoring_moves_one_row_for_each_document(spark, docs):
    """No feature row is exchanged: the sums are broadcast, added up in place and grouped by document."""
    rows = staged(words(docs, ["label"]), "features")
    model = naive_bayes.fit(rows, docs)
    plan = naive_bayes.score(rows, model, ["label"], docs=docs)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2  # partial sums by document, and the documents unless they are few
    assert "Generate inline(cells" not in plan and "collect_list" not in plan


def test_gaussian_out_of_fold_equals_refits(spark):
    """Large values with a small spread, zeros, a feature that every row has, and one that a fold lacks."""
    rng = np.random.default_rng(11)
    rows, docs = [], []
    for i in range(60):
        label = "a" if i % 3 else "b"
        docs.append((i, label, i % 4))
        rows.append((i, "time", 1.7e9 + (i % 7) + (3.0 if label == "a" else 0.0), label, i % 4))
        for f in range(5):
            if rng.random() < 0.5:
                rows.append((i, f"f{f}", float(rng.normal(f, 1 + f)), label, i % 4))
        if i % 4 == 2:
            rows.append((i, "once", float(i), label, 2))
    feats = staged(spark.createDataFrame(rows, "doc_id long, feature string, value double, label string, fold int"), "feats")
    sides = spark.createDataFrame(docs + [(99, "a", 1)], "doc_id long, label string, fold int")
    found, model = gaussian.cross_fit(feats, sides, 4, ["label"])
    got = scores_of(found)
    assert len(got) == 61 and model.folds == 4
    for j in range(4):
        plain = gaussian.fit(feats.where(f"fold <> {j}"), sides.where(f"fold <> {j}"))
        for id, want in scores_of(gaussian.score(feats.where(f"fold = {j}"), plain, docs=sides.where(f"fold = {j}"))).items():
            # a feature of this fold alone costs every class the same
            assert got[id][0] - got[id][1] == pytest.approx(want[0] - want[1], rel=1e-6, abs=1e-5)
    whole = scores_of(gaussian.score(feats, gaussian.fit(feats, sides), docs=sides))
    merged = scores_of(gaussian.score(feats, model.merged(), docs=sides))
    for id, want in whole.items():
        assert merged[id] == pytest.approx(want, rel=1e-6)


def test_products_of_cells_stay_out_of_python(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 1, 3.0)], "doc_id bigint, idx bigint, value double")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "idx bigint, v array<double>")
    product = svd._product(cells, vectors, "idx", "doc_id", 2)
    assert "InArrow" not in product._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["v"] for r in product.collect()} == {1: [2.5, 3.0], 2: [1.5, -3.0]}


def test_svd_with_a_held_block_joins_nothing(spark, monkeypatch):
    """Documents cut over partitions are put together again; a step of the iteration is no join."""
    rng = np.random.default_rng(11)
    matrix = rng.poisson(0.5, (80, 30)) * rng.random((80, 30))
    rows = [(i, 3 * j + 1, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    rows += [(5, 4, None), (None, 1, 2.0)]
    cells = staged(spark.createDataFrame(rows, "doc_id bigint, idx bigint, value double").repartition(5), "cells")
    plain = svd.fit(cells, 3, iterations=6, broadcast_bytes=0)
    monkeypatch.setattr(svd, "lookup_join", None)
    held = svd.fit(cells, 3, iterations=6)
    assert held.singular_values == pytest.approx(plain.singular_values, rel=1e-6)
    a, b = ({r["idx"]: np.abs(r["v"]) for r in m.loadings.collect()} for m in (held, plain))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)
