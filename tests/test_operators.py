import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import lookup, splits, vectorize
from lexigrid.operators.ranking import exact_rank, running_sum
from lexigrid.session import shared_dir, staged
from lexigrid.sources import readers


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, "big" if rng.random() < 0.6 else f"k{rng.randrange(50)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, label string")


def test_exact_rank_over_everything_and_by_group(spark):
    rows, df = skewed(spark)
    found = exact_rank(df, ["doc_id"], ["label"]).collect()
    expected = {}
    seen = Counter()
    for i, k in sorted(rows):
        expected[i] = seen[k]
        seen[k] += 1
    assert {r["doc_id"]: r["rank"] for r in found} == expected
    whole = exact_rank(df.select("label").distinct(), ["label"]).orderBy("rank").collect()
    assert [r["label"] for r in whole] == sorted({k for _, k in rows})
    assert [r["rank"] for r in whole] == list(range(len(whole)))


def test_exact_rank_keeps_null_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "doc_id int, label string")
    assert {r["doc_id"]: r["rank"] for r in exact_rank(df, ["doc_id"], ["label"]).collect()} == {1: 0, 2: 1, 3: 0}


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "s int, v bigint")
    found = {r["s"]: r["below"] for r in running_sum(df, ["s"], "v", "below").collect()}
    total = 0
    for i in range(500):
        assert found[i] == total
        total += i % 7


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_is_the_same_with_and_without_broadcast(spark, how, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.05)
    _, facts = skewed(spark)
    keys = spark.createDataFrame([("big", 1)] + [(f"k{i}", i) for i in range(40)], "label string, v int")
    small = lookup.lookup_join(facts, keys, ["label"], how).collect()
    large = lookup.lookup_join(facts, keys, ["label"], how, broadcast_bytes=0).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, large))


@pytest.mark.parametrize("n", [200, 2000])
def test_join_and_vocabulary_grow_in_partitions_not_in_their_size(spark, n, monkeypatch):
    monkeypatch.setattr(lookup, "JOIN_BYTES", 4000)
    facts = spark.createDataFrame([(i, f"k{i}", 1.0) for i in range(n)], "doc_id long, feature string, value double")
    ranges = []
    monkeypatch.setattr(vectorize, "exact_rank", lambda *a, **k: ranges.append(k["parts"]) or exact_rank(*a, **k))
    found = vectorize.transform(facts, vectorize.fit_vocabulary(facts), broadcast_bytes=0)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 80 and n / ranges[0] <= 160


def test_split_is_exact_stratified_and_repeatable(spark):
    rows, df = skewed(spark, 997)
    found = splits.stratified_split(df).collect()
    assert len(found) == 997 and sum(r["split"] == "test" for r in found) == 300  # ceil(0.3 * 997)
    sizes = Counter(k for _, k in rows)
    held = Counter(r["label"] for r in found if r["split"] == "test")
    for k, n in sizes.items():
        assert abs(held[k] - 0.3 * n) <= 1
    again = splits.stratified_split(df.repartition(7)).collect()
    assert {r["doc_id"]: r["split"] for r in found} == {r["doc_id"]: r["split"] for r in again}
    for side in ("train", "test"):
        for k in sizes:
            ranks = sorted(r["rank"] for r in found if r["split"] == side and r["label"] == k)
            assert ranks == list(range(len(ranks)))


def test_folds_are_balanced(spark):
    _, df = skewed(spark, 1001)
    by_label = defaultdict(Counter)
    for r in splits.stratified_folds(df, 5).collect():
        by_label[r["label"]][r["fold"]] += 1
    for c in by_label.values():
        assert max(c.values()) - min(c[f] for f in range(5)) <= 1


def test_subsets_are_nested(spark):
    _, df = skewed(spark, 800)
    train = staged(splits.stratified_split(df).where("split = 'train'"))
    n = train.count()
    ids = [{r["doc_id"] for r in splits.nested_subset(train, p, 4).collect()} for p in (1, 2, 3)]
    assert ids[0] < ids[1] < ids[2]
    assert [len(x) for x in ids] == [n * p // 4 for p in (1, 2, 3)]


def test_quotas_survive_sizes_beyond_a_bigint(spark):
    sizes = spark.createDataFrame([("a", 9_000_000_000), ("b", 1_000_000_001)], "label string, n_label bigint")
    total = F.ceil(F.lit(0.3) * F.col("_all"))
    found = {r["label"]: r["quota"] for r in splits.label_quotas(sizes, total).collect()}
    # shares 2700000000.63 and 300000000.37: the one left over goes to the first
    assert found == {"a": 2_700_000_001, "b": 300_000_000}


def test_label_cap(spark):
    rows = [(i, f"t{i}", "en" if i % 2 else ("fr" if i % 4 else "de")) for i in range(40)] + [(99, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label string")
    found = readers.label_cap(docs, {"en": 2, "fr": -1, "de": 0}).collect()
    assert sorted(r["doc_id"] for r in found if r["label"] == "en") == [1, 3]
    assert sum(r["label"] == "fr" for r in found) == 10
    assert not any(r["label"] == "de" for r in found)
    assert any(r["label"] is None for r in found)


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('label,intro,extra\nDF,"one, ""two""\nlines",7\nML,plain,8\nML,more,9\n')
    found = readers.read_csv(spark, str(path), "intro", "label", features="extra").orderBy("doc_id").collect()
    assert [(r["text"], r["label"], r["extra"]) for r in found] == [
        ('one, "two"\nlines', "DF", "7"), ("plain", "ML", "8"), ("more", "ML", "9"),
    ]
    assert readers.read_csv(spark, str(path), 1, 0).count() == 3
    assert readers.read_csv(spark, str(path), 1, 0, no_header=True).count() == 4
    capped = readers.read_csv(spark, str(path), "intro", "label", selection={"ML": 1}).collect()
    assert sorted(r["label"] for r in capped) == ["DF", "ML"]
    parse = tmp_path / "p.csv"
    parse.write_text('t,l,p\nx,a,"[{""token"":""x"",""lemma"":""y"",""pos"":""N"",""sent"":0}]"\n')
    assert tuple(readers.read_csv(spark, str(parse), 0, 1, parse=2).first()["parse"][0]) == ("x", "y", "N", 0)


def test_chain_and_texts(spark):
    a = readers.read_texts(spark, ["x", "x"])
    found = readers.chain({"one": a, "two": a.withColumn("extra", F.lit(1))}).collect()
    assert Counter((r["source"], r["extra"]) for r in found) == {("one", None): 2, ("two", 1): 2}


def test_vocabulary_and_labels(spark):
    rows = spark.createDataFrame(
        [(0, "é", 2.0), (0, "b", 1.0), (1, "Z", 4.0), (1, "b", 0.0)], "doc_id bigint, feature string, value double"
    )
    vocab = vectorize.fit_vocabulary(rows)
    assert [(r["feature"], r["idx"]) for r in vocab.orderBy("idx").collect()] == [("Z", 0), ("b", 1), ("é", 2)]
    cells = vectorize.transform(rows, vocab.where("feature <> 'é'")).collect()
    assert sorted((r["doc_id"], r["idx"], r["value"]) for r in cells) == [(0, 1, 1.0), (1, 0, 4.0), (1, 1, 0.0)]
    scaled = vectorize.scale_max_abs(rows, vectorize.fit_max_abs(rows.where("value = 0"))).collect()
    assert [tuple(r) for r in scaled if r["feature"] == "b"] == [(0, "b", 0.0), (1, "b", 0.0)]
    labelled = spark.createDataFrame([(0, "b"), (1, "a")], "doc_id bigint, label string")
    index = vectorize.fit_labels(labelled)
    assert {r["label"]: r["label_idx"] for r in index.collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="unknown label"):
        vectorize.encode_labels(labelled.withColumn("label", F.lit("c")), index).collect()
    assert vectorize.is_single_class(labelled.where("label = 'a'")) and not vectorize.is_single_class(labelled)


def test_stages_are_written_to_the_named_folder(spark):
    df = staged(spark.range(3))
    assert all(shared_dir(spark) in f for f in df.inputFiles())
