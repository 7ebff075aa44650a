import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import annotate as A, placement
from lexigrid.operators.features import (
    Custom, FunctionWords, LexiconSentiment, Meta, Ngrams, SimpleStats, WordEmbeddings, extract_features, merge_features,
)
from lexigrid.operators.ngrams import ngrams
from lexigrid.operators.placement import by_document


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def counts(df):
    return {(r["doc_id"], r["feature"]): r["value"] for r in df.collect()}


def only(df):
    return {k[1]: v for k, v in counts(df).items()}


@pytest.mark.parametrize(
    "level, n, text, expected",
    [
        ("char", 2, "ab", {"char-_": 2, "char-_a": 1, "char-a_b": 1, "char-b_": 1}),
        ("char", 3, "", {"char-__": 4}),
        ("char", 1, "ab", {"char-": 2, "char-a": 1, "char-b": 1}),
        ("text", 1, "a  b ", {"text-": 4, "text-a": 1, "text-b": 1}),
        ("text", 1, "", {"text-": 3}),
        ("token", 1, "a b", {"token-": 2, "token-a": 1, "token-b": 1}),
    ],
)
def test_small_texts(spark, level, n, text, expected):
    assert only(ngrams(frame(spark, text), level, (n,))) == expected


def test_emoji_is_one_item(spark):
    rows = ngrams(frame(spark, "a\U0001F600b"), "char", (3,))
    assert rows.agg(F.sum("value")).first()[0] == 7
    assert "char-a_\U0001F600_b" in only(rows)


def test_names_that_collide_are_added(spark):
    assert only(ngrams(frame(spark, "_"), "char", (1, 2)))["char-_"] == 1 + 2


def test_total_is_length_plus_n_plus_one(spark):
    texts = ["x" * k for k in range(6)]
    for n in (1, 2, 3):
        total = ngrams(frame(spark, *texts), "char", (n,)).agg(F.sum("value")).first()[0]
        assert total == sum(len(t) + n + 1 for t in texts)


def test_counting_placed_documents_needs_no_shuffle(spark):
    plan = ngrams(by_document(frame(spark, "a b")), "char", (3,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def lexicon(spark):
    return spark.createDataFrame(
        [("de", "de", "LID(bep)"), ("loopt", "lopen", "WW(pv)"), ("niet", "niet", "BW()")], "token string, lemma string, pos string"
    )


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_annotation(spark, broadcast_bytes):
    docs = A.annotate(frame(spark, "De man loopt. Niet", ""), lexicon(spark), broadcast_bytes=broadcast_bytes)
    found = {r["doc_id"]: [tuple(p) for p in r["parse"]] for r in docs.collect()}
    assert found[0] == [
        ("De", "de", "LID(bep)", 0), ("man", "man", "X()", 0), ("loopt.", "loopt.", "X()", 0), ("Niet", "niet", "BW()", 1),
    ]
    assert found[1] == [("", "", "X()", 0)]


def test_given_parses_are_kept(spark):
    docs = frame(spark, "de", "de").withColumn(
        "parse", F.when(F.col("doc_id") == 0, A.parse_json(F.lit('[{"token":"t","lemma":"l","pos":"P","sent":7}]')))
    )
    found = {r["doc_id"]: [tuple(p) for p in r["parse"]] for r in A.annotate(docs, lexicon(spark)).collect()}
    assert found == {0: [("t", "l", "P", 7)], 1: [("de", "de", "LID(bep)", 0)]}
    tagged = A.annotate_with(docs, lambda t: [(t, t, "Q", 0)])
    assert {r["doc_id"]: [tuple(p) for p in r["parse"]] for r in tagged.collect()} == {
        0: [("t", "l", "P", 7)], 1: [("de", "de", "Q", 0)],
    }


def test_a_tagger_works_off_runs_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(A, "RUN_BYTES", 10)
    texts = ["abcd", None, "efgh", "x" * 99, "", "ij"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert [r.column(0).to_pylist() for r in A._text_runs(batch, "text")] == [["abcd", None, "efgh"], ["x" * 99], ["", "ij"]]
    given = F.when(F.col("doc_id") % 3 == 1, A.parse_json(F.lit('[{"token":"t","lemma":"l","pos":"P","sent":7},{"token":"u"}]')))
    docs = frame(spark, *[f"w{i} v" for i in range(50)]).withColumn("parse", given).coalesce(1)
    tagged = A.annotate_with(docs, lambda t: [(w, w, "Q") for w in t.split(" ")])  # taggers may leave out the sentence
    assert {r["doc_id"]: [tuple(p) for p in r["parse"]] for r in tagged.collect()} == {
        i: [("t", "l", "P", 7), ("u", None, None, None)] if i % 3 == 1 else [(f"w{i}", f"w{i}", "Q", None), ("v", "v", "Q", None)]
        for i in range(50)
    }


def parsed(spark):
    rows = [(0, "x", [("de", "de", "LID(bep)", 0), ("de", "de", "LID(bep)", 0), ("loopt", "lopen", "WW(pv,tgw)", 1)])]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, parse {A.PARSE}")


def test_parse_based_features(spark):
    assert only(FunctionWords()(parsed(spark))) == {"de": 2.0}
    assert only(Ngrams("pos", (1,))(parsed(spark))) == {"pos-": 2, "pos-LID(bep)": 2, "pos-WW(pv,tgw)": 1}
    assert only(SimpleStats(False, False, True)(parsed(spark))) == {"avg_sent_len": 1.5}
    with pytest.raises(NotImplementedError):
        FunctionWords.for_language("en")
    with pytest.raises(ValueError):
        Ngrams("pos", (1,))(frame(spark, "x"))
    with pytest.raises(ValueError):
        SimpleStats()(frame(spark, "x"))


def test_sentiment_takes_word_before_lemma_and_first_rule(spark):
    rows = [
        (0, [("loopt", "lopen", "WW(pv)", 0), ("mooi", "mooi", "ADJ(vrij)", 0), ("x", "x", "LET()", 0)]),
        (1, [("gezien", "zien", "WW(vd,prenom)", 0)]),
        (2, []),
    ]
    docs = spark.createDataFrame(rows, f"doc_id bigint, parse {A.PARSE}")
    lex = spark.createDataFrame(
        [("lopen", "v", 1.0), ("mooi", "a", 2.0), ("mooi", "n", 50.0), ("zien", "v", 4.0), ("x", "n", 9.0)],
        "term string, tag string, polarity double",
    )
    assert counts(LexiconSentiment(lex)(docs)) == {(0, "sentiment"): 3.0, (1, "sentiment"): 4.0, (2, "sentiment"): 0.0}


def test_flooding(spark):
    found = only(SimpleStats(True, False, False)(frame(spark, "sooo coool!!! aa 12 3 _EMOTICON_")))
    assert (found["flood_norm_len"], found["flood_alph_len"], found["flood_punc_len"]) == (3, 2, 1)
    assert (found["flood_norm_avg"], found["flood_alph_avg"], found["flood_punc_avg"]) == (3, 3, 3)
    assert (found["num_punc"], found["num_num"], found["num_emots"]) == (1, 2, 1)
    found = only(SimpleStats(True, False, False)(frame(spark, "\n\n\n\n")))
    assert found["flood_norm_len"] == 0 and found["flood_norm_avg"] == 0


def test_token_statistics(spark):
    tokens = ["ABC-9", "fooBAR", "AbCd", "_URL_", "__PHOTO__", "x"]
    rows = [(0, [(t, t, "N", 0) for t in tokens])]
    docs = spark.createDataFrame(rows, f"doc_id bigint, parse {A.PARSE}").withColumn("text", F.lit(""))
    found = only(SimpleStats(False, True, False)(docs))
    assert found == {
        "word_len": float(sum(map(len, tokens))), "cap_words": 8.0, "start_cap": 2.0,
        "num_urls": 1.0, "num_phots": 1.0, "num_vids": 0.0,
    }


def test_embeddings_are_means_of_known_words(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0])], "token string, embedding array<float>")
    found = only(WordEmbeddings(vectors, 2)(frame(spark, "a b b z")))
    assert found == pytest.approx({"emb_0": 7 / 3, "emb_1": 8 / 3})


def test_meta_custom_and_merge(spark):
    docs = frame(spark, "ab").withColumn("src", F.lit("s")).withColumn("n", F.lit(3)).withColumn("none", F.lit(None).cast("string"))
    assert only(Meta(("src", "n", "none"))(docs)) == {"meta_src=s": 1.0, "meta_n": 3.0}
    first = Custom(lambda text, parse: {"len": len(text), "kind": "z"})
    second = Custom(lambda text, parse: {"len": 99})
    assert only(first(docs)) == {"len": 2.0, "kind=z": 1.0}
    assert only(extract_features(docs, [first, second])) == {"len": 99.0, "kind=z": 1.0}
    assert only(merge_features([second(docs), first(docs)]))["len"] == 2.0
    assert only(extract_features(docs, [first], cleaner=lambda c: F.concat(c, F.lit("!!"))))["len"] == 4.0


def test_partitions_of_documents_grow_with_their_texts(spark, monkeypatch):
    monkeypatch.setattr(placement, "PART_BYTES", 1000)
    few, many = frame(spark, *["a b " * 25] * 40), frame(spark, *["a b " * 25] * 400)
    assert by_document(few).rdd.getNumPartitions() == 6 and by_document(many).rdd.getNumPartitions() == 53
    sides = many.select("doc_id", F.lit("x").alias("side"))
    assert by_document(many, sides).rdd.getNumPartitions() == 53
    assert placement.parts_for(frame(spark)) == 1


def test_embeddings_are_summed_without_sorting_objects(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 4.0])], "token string, embedding array<float>")
    plan = WordEmbeddings(vectors, 2)(by_document(frame(spark, "a b b z")))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_vectors_in_blocks_go_to_the_documents(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)] + [(50, None)], "vec_id bigint, embedding array<float>")
    words = spark.createDataFrame([(f"w{i}", i % 51) for i in range(60)], "token string, vec_id bigint")
    texts = [" ".join(f"w{(i * k) % 70}" for k in range(40)) for i in range(30)]
    docs = by_document(frame(spark, *texts, None))
    want = {(r["doc_id"], r["feature"]): r["value"] for r in WordEmbeddings(words, 2, table)(docs).collect()}
    blocks = WordEmbeddings(words, 2, table, broadcast_bytes=500)(docs)
    found = {(r["doc_id"], r["feature"]): r["value"] for r in blocks.collect()}
    assert len(want) == 60 and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v) for k, v in want.items())
    assert "vec_id" not in blocks._jdf.queryExecution().executedPlan().toString()  # nothing is left to meet by shuffle
