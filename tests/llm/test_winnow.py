"""Decontamination against a search for every window in every text."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexigrid.llm import queries, winnow
from lexigrid.operators.lookup import lookup_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items):
    found = []
    for doc, text in docs:
        words = plain_words(text)
        hit, ids = set(), set()
        for item, other in items:
            of = plain_words(other)
            n = min(len(of), 10)
            for s in range(len(of) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == of[s : s + n]:
                        hit.update(range(at, at + n))
                        ids.add(item)
        found.append((doc, len(words), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(found, key=str)


def ours(docs, items):
    found = winnow.contaminated(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str)


@pytest.fixture(scope="module")
def items(prose):
    rows = [(i, prose(f"item{i}", 6 + 5 * i, 40)) for i in range(12)]
    rows += [(40, "The"), (41, "kurz É9 zwei"), (42, None), (43, "  ...  "), (44, prose("item3", 21, 40)), (44, "word1 word2")]
    return [*rows, (None, prose("nobody", 15, 40)), (45, " ".join(["same"] * 14))]


def test_against_brute_force(spark, items, prose):
    draw = random.Random(3)
    docs = [(i, prose(f"doc{i}", draw.randrange(0, 120), 40)) for i in range(60)]
    for i in range(60, 100):
        passage = plain_words(draw.choice(items)[1])
        cut = passage[draw.randrange(3) : max(0, len(passage) - draw.randrange(3))]
        docs.append((i, f"{prose(i, 20)}, {'-'.join(cut).upper()}! {prose(i + 1, 20)} {' '.join(passage)}"))
    docs += [(100, "the THE thee"), (101, "KURZ É9\tzwei. kurz é9 zwei"), (102, " ".join(["same"] * 300)), (102, "same " * 9)]
    found = ours(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert found == brute(docs, items)
    assert sum(r[2] > 0 for r in found) > 40


def test_sides_too_large_to_broadcast(spark, items, prose, monkeypatch):
    monkeypatch.setattr(winnow, "lookup_join", lambda *a, **k: lookup_join(*a, **{**k, "broadcast_bytes": 0}))
    docs = [(i, prose(f"item{i % 12}", 60, 40)) for i in range(30)]
    found = ours(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found == brute(docs, items)


def test_edge_rows(spark, edge, edge_rows, nothing, items):
    known = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items], "item_id long, text string, doc_id string, n_words double")
    rows = [(r[0], r[1]) for r in edge_rows]
    assert ours(edge, known) == brute(rows, items)
    long = spark.createDataFrame([(9, rows[3][1])], "item_id long, text string")
    whole = {r["doc_id"]: r for r in winnow.contaminated(edge, long).collect()}
    assert whole[4]["n_hit"] == whole[4]["n_words"] == 30_000 and whole[4]["items"] == ["9"]
    assert winnow.contaminated(nothing, known).count() == 0
    none = nothing.withColumnRenamed("doc_id", "item_id")
    assert {r["n_hit"] for r in winnow.contaminated(edge, none).collect()} == {0}


def test_every_window_keeps_a_fingerprint_and_few_are_kept(prose):
    data = prose(1, 5000, 3000).encode()
    hashes, bounds = winnow.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    prints = winnow.fingerprints(hashes, winnow.window_starts(bounds, 10))
    each = winnow.grams(hashes, np.arange(len(hashes) - 4), 5)
    assert all(p == each[i : i + 6].min() for i, p in enumerate(prints))
    assert len(np.unique(prints)) < 0.35 * len(each)


def test_digest_of_the_query(spark, tmp_path, prose):
    passage = prose("q", 12)
    spark.createDataFrame([(1, passage), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, passage), (9, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in queries.op12_contamination(spark, str(tmp_path)).collect()}
    assert found[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and found[1]["n_items"] == 2
    assert found[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not found[2]["contaminated"]
