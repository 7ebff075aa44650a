"""The filter audit against running every order of the filters over all documents."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from lexigrid.llm import audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows):
    out = []
    for id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any(i is not None and id is not None and i < id and (t or "") == text for i, t, _ in rows),
        })
    return out


def brute(rows, good=(), toxic=()):
    bad = fails(rows)
    found, shapley = {}, Counter()
    parts = {p or "" for _, _, p in rows}
    for order in map("".join, permutations("ABCDE")):
        left = {p: [i for i, r in enumerate(rows) if (r[2] or "") == p] for p in parts}
        for step, f in enumerate(order, 1):
            for p in parts:
                gone = [i for i in left[p] if bad[i][f]]
                left[p] = [i for i in left[p] if not bad[i][f]]
                here = [i for i, r in enumerate(rows) if (r[2] or "") == p]
                shapley[p, f] += len(gone)
                found[p, order, step] = [
                    len(left[p]), len(gone), sum(bad[i][f] for i in here) - len(gone),
                    sum(bad[i][f] and sum(bad[i].values()) == 1 for i in here),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone),
                ]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in found.items()}


def ours(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in found.collect()}


def random_rows(n, seed=5):
    draw = random.Random(seed)
    texts = [" ".join(f"{'Word' if k % 3 else 'word'}{draw.randrange(20 + 60 * k)}" for _ in range(draw.choice([20, 199, 200, 260]))) for k in range(9)]
    texts += [t + " 5 %" for t in texts[:3]] + ["", None, "HOT COPY"]
    rows = [(i, draw.choice(texts) if draw.random() < 0.6 else "HOT COPY", draw.choice(["a", "b", "b", None])) for i in range(n)]
    rows += [(rows[7][0], rows[7][1], "b"), (None, "HOT COPY", "a"), (None, texts[0], "b"), (3, "of its own", "a")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batches", "pages"), [(1, 1024), (6, 4)])
def test_against_every_order_run_by_hand(spark, tmp_path, batches, pages):
    rows = random_rows(90)
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 90, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    path = f"{tmp_path}/documents.parquet"
    # ids go down from file to file, so that what was said of earlier files is taken back
    ordered = sorted(rows, key=lambda r: -(r[0] or 0))
    for k in range(6):
        part = ordered[k * len(rows) // 6 : (k + 1) * len(rows) // 6]
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)
    marks = spark.createDataFrame([(i, int(q), None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q and i is not None}
    toxic = {i for i, _, t in labels if t and i is not None}
    assert ours(audit.audit(spark, path, marks, batches=batches, page_rows=pages)) == brute(rows, good, toxic)


def test_originals_are_taken_back(spark, tmp_path):
    path, sinks = f"{tmp_path}/documents.parquet", []
    for id in (9, 5, 7, 2):
        row = spark.createDataFrame([(id, "same", f"s{id}")], "doc_id long, text string, source string")
        row.coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    keep = audit.new_path
    try:
        audit.new_path = lambda s, name: sinks.append(keep(s, name)) or sinks[-1]
        counts = {(r["part"], bool(r["flags"] & audit.COPY)): r["n"] for r in audit.counted(spark, path, labels, batches=4).collect()}
    finally:
        audit.new_path = keep
    assert counts == {("s2", False): 1, ("s5", True): 1, ("s7", True): 1, ("s9", True): 1}
    said = spark.read.parquet(next(p for p in sinks if "changes" in p)).collect()
    assert sorted((r["part"], r["n"]) for r in said if r["n"] < 0) == [("s5", -1), ("s9", -1)]


def test_edge_rows(spark, edge, edge_rows, nothing, tmp_path):
    edge.selectExpr("*", "n AS mask", "text AS key", "n AS flags").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    found = audit.audit(spark, f"{tmp_path}/documents.parquet", labels)
    assert ours(found) == brute([(r[0], r[1], r[3]) for r in edge_rows], {1})
    nothing.write.parquet(f"{tmp_path}/none.parquet")
    assert audit.audit(spark, f"{tmp_path}/none.parquet", labels).count() == 0
