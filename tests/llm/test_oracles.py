"""Registered queries against their SQL, and their contracts, on the smallest tables."""

import os
import zlib

import pytest

import check_queries
from lexigrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(check_queries, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(check_queries, "ORACLES", queries.ORACLES)
    good, note = check_queries.compare(spark, check_queries.connect(SF), SF, name)
    assert good, note


@pytest.mark.parametrize(("name", "modulus", "remainder", "cut"), [("op2_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3)])
def test_scores_of_every_document(spark, name, modulus, remainder, cut):
    rows = queries.QUERIES[name](spark, SF).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut)


def test_language_of_every_document(spark):
    found = {r["doc_id"]: r for r in queries.op7_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(found[r["doc_id"]]["held_out"] for r in held)
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
