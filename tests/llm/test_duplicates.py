"""Near-duplicates of texts and vectors, and components, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import neardup, text as T, vectors
from lexigrid.llm.components import components


def plain_classes(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(draw.randrange(50, 150), draw.randrange(50, 150)) for _ in range(60)]
    edges += [(200, k) for k in range(201, 240)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_classes(300, edges)
    assert found == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(words, draw, share):
    return [f"new{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus(prose):
    draw = random.Random(4)
    shared = prose("passage", 60)
    texts = []
    for i in range(40):
        base = prose(i, 90, 5000).split()
        texts.append(" ".join(base))
        if i % 4 == 0:
            texts += [" ".join(edited(base, draw, k / 150)) for k in range(5)]
        if i % 5 == 0:
            texts += [" ".join(base).upper(), shared + " " + prose(f"x{i}", 40, 5000)]
    hot = prose("hot", 120, 5000).split()
    texts += [" ".join(edited(hot, draw, 0.01)) for _ in range(60)]
    return texts


def test_text_classes_against_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)  # groups are cut into blocks
    n = len(corpus)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    weights = neardup._common(docs, 0.01)
    sets = []
    for _, points, offsets in T.chunks(pa.array(corpus)):
        keys, counts, bounds, _ = neardup.shingles(points, offsets)
        found = weights.of(keys, counts)
        sets += [dict(zip(keys[a:b].tolist(), found[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:])]
    # the same words give the same shingles, counted by hand
    plain = corpus[0].lower().split()
    assert len(sets[0]) == len({tuple(plain[k : k + 5]) for k in range(len(plain) - 4)})

    def alike(a, b):
        low = sum(min(a.get(k, 0), b.get(k, 0)) for k in a)
        return low / (sum(a.values()) + sum(b.values()) - low)

    pairs = [(i, j) for i in range(n) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    found = {r["doc_id"]: (r["class_id"], r["kept"]) for r in neardup.classes(docs).collect()}
    want = plain_classes(n, pairs)
    assert found == {i: (c, c == i) for i, c in enumerate(want)}
    assert len(set(want)) < n - 80


def test_document_frequency_is_exact(spark):
    rows = [(i, "one two three four five" + f" tail{i} end{i}" * (i > 3)) for i in range(12)]
    weights = neardup._common(spark.createDataFrame(rows, "doc_id long, text string"), 0.5)
    assert len(weights.keys) == 1
    assert weights.values[0] == pytest.approx(0.5 + 0.5 * min(1, np.log1p(1) / np.log1p(2)))


def test_text_edges(edge, nothing):
    found = neardup.classes(edge).collect()
    assert len(found) == 12
    of = {r["doc_id"]: (r["class_id"], r["kept"]) for r in found if r["doc_id"] is not None}
    assert of[1] == of[2][:1] + (True,) and of[2] == (1, False)  # null as empty
    assert of[5] == (5, True) and of[6] == (5, False)
    assert of[7] == (7, True) and of[8] == (8, True) and of[3] == (3, True)
    assert sorted(r["kept"] for r in found if r["doc_id"] is None) == [False, True]
    assert neardup.classes(nothing).count() == 0


def plain_links(x, least=0.9):
    good = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = {i: np.array(x[i], float) / np.linalg.norm(np.array(x[i], float)) for i in good}
    return [(i, j) for i in good for j in good if j < i and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least]


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST", 32)  # lists are cut into blocks
    monkeypatch.setattr(vectors, "QUERIES", 64)
    draw = np.random.default_rng(6)
    x = [v.tolist() for v in draw.normal(size=(300, 16)).astype(np.float32)]
    for i in range(0, 60, 3):
        x += [(np.array(x[i]) + draw.normal(scale=s, size=16)).astype(np.float32).tolist() for s in (0.1, 0.2, 0.3, 0.4)]
    hot = draw.normal(size=16)
    x += [(hot + draw.normal(scale=0.05, size=16)).astype(np.float32).tolist() for _ in range(150)]
    x += [x[0], x[0], [2 * c for c in x[1]], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + x[2][1:], [1.0, 2.0], [None] + x[3][1:]]
    rows = [(i, v, i % 3) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    pairs = plain_links(x)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(x))
    roots = plain_classes(len(x), pairs)
    found = {r["vec_id"]: r for r in vectors.near_vectors(table, per_list=40).collect()}
    assert len(found) == len(x)
    assert sum(found[i]["n_links"] for i in found) >= 0.98 * links.sum()
    assert all(found[i]["n_links"] <= links[i] for i in found)
    exact = vectors.near_vectors(table, per_list=40, probes=1000).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in exact} == {
        i: (links[i], roots[i], roots[i] == i) for i in range(len(x))
    }


def test_vectors_of_every_length(spark):
    """The fewest of a length link as the most do, also with an id twice and vectors shorter than the code has parts."""
    draw = np.random.default_rng(8)
    x = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 0.0], [0.0, 1.0], [0.1, 1.0], [5.0], [2.0], [-1.0]]
    for d in (9, 40):
        base = draw.normal(size=d)
        x += [(base + draw.normal(scale=0.1, size=d)).tolist() for _ in range(6)] + draw.normal(size=(20, d)).tolist()
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    pairs = plain_links(x)
    links, roots = np.bincount(np.array(pairs).ravel(), minlength=len(x)), plain_classes(len(x), pairs)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table).collect()}
    assert found == {i: (links[i], roots[i], roots[i] == i) for i in range(len(x))}
    assert found[1] == (1, 0, False) and found[6] == (1, 5, False)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(table).count() == 0
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
