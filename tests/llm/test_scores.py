"""Quality, toxicity and language: brute force on small data, held-out accuracy, edge cases."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import language, quality, text as T, toxicity


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_tokens_and_hashes():
    texts = pa.array(["The cat!! the", None, "", "THE", "a" * 50 + " CAT"])
    ((at, points, offsets),) = T.chunks(texts)
    hashes, starts, owners = T.runs(points, offsets, marks=True)
    assert at == 0 and owners.tolist() == [0, 0, 0, 0, 3, 4, 4]
    assert hashes[0] == hashes[3] == hashes[4] and hashes[1] == hashes[6] != hashes[2]
    assert starts.tolist() == [0, 4, 7, 10, 13, 16, 67]
    ends = [n for _, _, o in T.chunks(texts, limit=1) for n in np.diff(o)]
    assert ends == [13, 0, 0, 3, 54]


def test_ftrl_keeps_rows_in_few_bytes():
    draw = np.random.default_rng(1)
    rows = ((draw.permutation(1 << 13)[:5000], float(i % 2)) for i in range(200))
    tracemalloc.start()
    quality.ftrl(rows, 13, 1)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 200 * 5000 * 12


def test_ftrl_against_plain_steps():
    draw = random.Random(1)
    rows = [(np.array([draw.randrange(16) for _ in range(5)]), float(draw.random() < 0.5)) for _ in range(40)]
    found = quality.ftrl(rows, 4, 2)
    z, n, alpha, beta, l1, l2 = defaultdict(float), defaultdict(float), 0.3, 1.0, 0.02, 0.02

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for slots, y in rows:
            x = {i: c / math.sqrt(5) for i, c in Counter(slots.tolist()).items()} | {16: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(found, [weight(i) for i in range(17)])


def test_quality_learns_and_keeps_edges(spark, edge, nothing, prose):
    rows = [(i, prose(i) if i % 3 else prose(i).replace(" ", "!! "), i % 3 > 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = labels_of(spark, [(i, int(y)) for i, _, y in rows if i < 160] + [(161, None), (None, 1)], "quality")
    model = quality.fit(docs, known)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((found[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 160)
    out = quality.score(edge, model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 and r["_position"] == "mine" for r in out)
    empty = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1 and empty.pop() == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert quality.score(nothing, model).count() == 0
    blank = quality.fit(docs, known.where("false"))
    assert {r["score"] for r in quality.score(docs, blank).collect()} == {0.5}


def test_word_models_are_distributions():
    draw = np.random.default_rng(0)
    counts = draw.poisson(0.7, (2, 6, 20)).astype(float)
    counts[0, 3] = 0  # a history never seen
    seen = (counts.sum(0) > 0).sum(0) + 0.5
    for c in counts:
        assert np.allclose(np.exp(toxicity.kneser_ney(c, seen / seen.sum())).sum(1), 1)
    assert np.isfinite(toxicity.ratios(counts)).all()


def test_toxicity_learns_rare_forms(spark, edge, nothing, prose):
    def text(i):
        words = prose(i).split()
        if i % 4 == 0:
            for k in range(3):
                words[(i + 17 * k) % 60] = f"grumble{i}{k}"  # forms never seen twice
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    known = labels_of(spark, [(i, int(i % 4 == 0)) for i in range(400)], "toxic")
    model = toxicity.fit(docs, known)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    right = [(found[i] >= 0.7) == (i % 4 == 0) for i in range(400, 600)]
    assert sum(right) >= 195
    out = toxicity.score(edge, model).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(nothing, model).count() == 0
    one = toxicity.fit(docs, known.where("toxic = 0"))
    assert one is None and {r["score"] for r in toxicity.score(docs, one).collect()} == {0.5}


def naive_kneser_ney(texts, order=4):
    """Interpolated Kneser-Ney over symbols, straight from the definition."""
    tops = Counter()
    for t in texts:
        padded = ("",) * (order - 1) + tuple(t)
        tops.update(padded[i : i + order] for i in range(len(t)))
    levels = {order: tops}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(g):
        if not g:
            return 1 / language.SYMBOLS
        c = levels[len(g)]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        lower = p(g[1:])
        if not total:
            return lower
        return max(c.get(g, 0) - d, 0) / total + sum(min(v, d) for v in same.values()) / total * lower

    return p


def test_language_model_against_definition(spark):
    texts = ["abc abd ab", "bca", "dd abcd"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    gap = ""

    def symbols(t):
        return [c if c.isalpha() else gap for c in t]

    p = naive_kneser_ney([symbols(t) for t in texts])
    for t in ["abc", "cab dab", "ddd"]:
        s = symbols(t)
        padded = [gap] * 3 + s
        want = -sum(math.log(p(tuple(padded[i : i + 4]))) for i in range(len(s))) / len(s)
        got, letters = model.entropies(pa.array([t]), model.codes())
        assert got[0, 0] == pytest.approx(want, rel=1e-5) and letters[0] == sum(map(str.isalpha, t))


def test_language_edges(spark, edge, nothing):
    draw = random.Random(5)
    speak = {"en": "the of and ing tion er".split(), "de": "der die und ung heit sch".split()}
    rows = [(i, " ".join(draw.choice(speak[k]) for _ in range(12)), k) for i in range(80) for k in speak]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id < 60"))
    found = language.identify(docs.where("doc_id >= 60"), model)
    assert found.where("lang <> lang_pred").count() == 0
    out = language.identify(edge, model).collect()
    assert len(out) == 12
    for r in out:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"]) == blank
    assert language.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(nothing)).collect()} == {"und"}
    assert docs.where(F.col("lang") == "en").count() == 80


def test_language_limits_and_heat_come_from_all_rows(spark):
    draw = random.Random(11)
    speak = {"en": "the of and ing tion er".split(), "de": "der die und ung heit sch".split()}
    rows = [(i, " ".join(draw.choice(speak["en" if i % 3 else "de"]) for _ in range(4)), "en" if i % 3 else "de") for i in range(2800)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), keep=0.99)
    h, _ = model.entropies(pa.array([t for _, t, _ in rows]), model.codes())
    true = np.array([model.languages.index(k) for _, _, k in rows])
    for i, name in enumerate(model.languages):
        assert model.limits[name] == pytest.approx(np.quantile(h[true == i, i], 0.99), rel=1e-6)
    rest = h - h.min(1, keepdims=True)
    loss = [(x * rest[np.arange(len(h)), true] + np.log(np.exp(-x * rest).sum(1))).mean() for x in language.HEATS]
    assert model.heat == language.HEATS[int(np.argmin(loss))]


def test_language_tells_all_letters_apart(spark):
    """Twelve scripts of fifty letters, one beyond the first plane; more letters than an alphabet of seven bits has."""
    firsts = [0x3041, 0x5D0 - 30, 0x0E01, 0x10D0, 0x0905, 0x1200, 0x3400, 0x4E00, 0xAC00, 0xA000, 0x0561, 0x20000]
    draw = random.Random(3)
    scripts = [[c for c in map(chr, range(first, first + 90)) if c.isalpha()][:50] for first in firsts]
    rows = [(i * 12 + k, " ".join("".join(draw.choices(own, k=6)) for _ in range(6)), f"s{k:02}") for i in range(30) for k, own in enumerate(scripts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs.where("doc_id >= 240"), language.fit(docs.where("doc_id < 240")))
    assert found.where("lang = lang_pred").count() == 120
    _, offsets = np.zeros(0), np.array([0, 3])
    codes, bounds, letters = language.grams(np.array([0x20000, 0x20, 0x41], np.uint32), offsets, language._symbols())
    assert codes[:2].tolist() == [0xD840, 0xD840DC00] and bounds.tolist() == [0, 4] and letters.tolist() == [2]


def test_language_keeps_the_rarest_grams(spark):
    draw = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    texts = ["".join(draw.choices(letters, k=3000)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    grams = {t[i : i + 4] for t in texts for i in range(len(t) - 3)}
    assert len(model.keys[-1]) >= len(grams) > 1 << 18


def test_toxicity_calibrates_over_all_rows_set_aside(spark, prose, monkeypatch):
    seen = []
    plain = toxicity._calibration
    monkeypatch.setattr(toxicity, "_calibration", lambda rows: seen.append(rows) or plain(rows))
    docs = spark.createDataFrame([(i, f"{prose(i % 50, 4)} {'grumble' if i % 4 == 0 else 'pleasant'}") for i in range(20_000)], "doc_id long, text string")
    docs = docs.crossJoin(spark.range(11)).select((F.col("doc_id") * 11 + F.col("id")).alias("doc_id"), "text")
    known = docs.select("doc_id", F.col("text").contains("grumble").cast("int").alias("toxic"))
    weights = toxicity.fit(docs, known).weights
    order = F.xxhash64("doc_id", F.lit("calibration")).bitwiseAND(F.lit((1 << 62) - 1))
    assert seen[0].count() == docs.where(order < (1 << 62) // 10).count() > 20_000
    rows = seen[0].toPandas()
    x, y = rows[[f"x{i}" for i in range(toxicity.INPUTS)]].to_numpy(), rows["y"].to_numpy()
    assert np.abs(x.T @ (1 / (1 + np.exp(-(x @ weights))) - y) + 0.1 * weights).max() < 1e-3
