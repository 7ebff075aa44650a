"""Alignment against token bytes compared one by one."""

import hashlib
import os
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from lexigrid.llm import alignment

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="needs the public tokenizer files")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain_ends(ids, tokens):
    return np.cumsum([len(tokens[i]) for i in ids]).tolist()


def brute(texts):
    (tokenizer, ranked, a), (model, b) = alignment.byte_level(A), alignment.pieces(B)
    assert ranked
    per_doc, held = [], Counter()
    for text in texts:
        ids = [], []
        if text:
            ids = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            whole = (" " + text).encode()
            if any(b"".join(s.tokens[i] for i in x) != whole for x, s in zip(ids, (a, b))):
                ids = [], []
        ends = [plain_ends(x, s.tokens) for x, s in zip(ids, (a, b))]
        both = set(ends[0]) & set(ends[1])
        sides = []
        for x, es in zip(ids, ends):
            sides.append([[]])
            for i, e in zip(x, es):
                sides[-1][-1].append(i)
                if e in both:
                    sides[-1].append([])
        groups = [list(g) for g in zip(*sides)][: len(both)]
        links = [link for x, y in groups for link in product(x, y)]
        held.update(set(links))
        per_doc.append((ids, groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for ids, groups, links in per_doc:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((
            len(ids[0]), len(ids[1]), len(groups), len(links), sum(held[k] == best[k[0]] for k in links),
            sum(held[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return rows


def ours(found):
    return [tuple(r[c] for c in COLUMNS) for r in sorted(found.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))]


@pytest.fixture(scope="module")
def texts(prose):
    draw = random.Random(8)
    odd = ["", None, "é", "  two  spaces\n\n\ttab", "a▁b", "<|endoftext|> and <s>", "日本語のテキスト 😀👩‍👩‍👧 ok", "naïve Ünïcödé façade",
           "x" * 5000, "=" * 3001 + "😀" * 400, "\x00nul\x7f", "don't we'll 12345678901234567890", " lead", "trail ",
           "\x85a\xa0 b\u2003 c\x1c d\u200b", "“don’t” — ‘it’s’ 1½ ª²  x", " " * 700 + "a", "'s't're 've", "œuvre € 50%"]
    made = [prose(i, draw.randrange(1, 80)) for i in range(20)]
    return odd + made + [made[0], made[0]] + ["the cat sat on the mat, " * 40, "Straßenbahnhaltestelle " * 30]


@pytest.mark.parametrize("held", [1 << 22, 50, 0])
def test_against_bytes_compared_one_by_one(spark, texts, held, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert ours(alignment.align(docs, A, B, held=held)) == brute(texts)


def test_links_in_small_slices(texts, monkeypatch):
    whole = alignment.Aligner(A, B).rows(texts)
    monkeypatch.setattr(alignment, "LINKS", 7)
    sliced = alignment.Aligner(A, B).rows(texts)
    for name in whole:
        assert list(whole[name]) == list(sliced[name])


def test_gallop_finds_every_end():
    draw = np.random.default_rng(3)
    for _ in range(200):
        n = draw.integers(1, 60)
        ends = []
        for _ in range(2):
            cuts = np.unique(draw.integers(1, 400, n))
            ends.append(np.append(cuts[cuts < 400], 400))
        a, b = ends
        in_a, in_b = alignment.common_ends(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[in_a].tolist() == both == b[in_b].tolist()


def test_edge_rows(spark, edge, edge_rows, nothing):
    clash = edge.selectExpr("*", "n AS row", "text AS a", "n AS times", "n AS n_best")
    found = alignment.align(clash, A, B)
    rows = sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is None, r[0]))
    want = brute([t for _, t in rows])
    assert sorted(ours(found), key=str) == sorted(want, key=str)
    assert alignment.align(nothing, A, B).count() == 0
