"""Sharding, mixing, packing: brute force and laws on small data."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import mixing, packing, sharding


def sized(docs):
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    return docs.select("doc_id", size, "n", "_position")


def test_shards_against_plain_sums(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(1, 500) if i % 50 else 20_000) for i in range(800)]
    draw.shuffle(rows)
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, size long").repartition(7), 8).collect()
    total, before, slots = sum(s for _, s in rows), 0, Counter()
    want = {}
    for i, s in sorted(rows):
        k = min(7, int((before + s / 2) * 8 / total))
        want[i], before = (k, slots[k]), before + s
        slots[k] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in found} == want


def test_shard_edges(edge, nothing):
    found = sharding.shard(sized(edge), 8, ("doc_id", "size")).collect()
    assert len(found) == 12 and all(0 <= r["shard"] < 8 and r["_position"] == "mine" for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(sized(nothing), 8).count() == 0


def plain_schedule(counts):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(counts), [0] * len(counts), []
    for t in range(total):
        ready = [
            (math.ceil((done[k] + 1) * total / n), k)
            for k, n in enumerate(counts)
            if done[k] < n and math.floor(done[k] * total / n) <= t
        ]
        k = min(ready)[1]
        out.append((k, done[k]))
        done[k] += 1
    return out


def test_schedule_against_brute_force(spark):
    sources = [("a", 7, 50), ("b", 3, 9), ("c", 1, 30), (None, 2, 4)]
    table = spark.createDataFrame([(s, c, b) for s, c, b in sources], "source string, c long, blocks long")
    found = defaultdict(dict)
    for r in mixing.schedule(table).collect():
        found[r["first"]][r["slot"]] = (r["source"], r["i"], r["base"], r["slots"])
    order = sorted(sources, key=lambda s: (s[0] is not None, s[0] or ""))
    firsts = sorted({0} | {b // c + k for _, c, b in sources for k in (0, 1)})
    for p in firsts:
        counts = [max(0, min(c, b - c * p)) for _, c, b in order]
        if not sum(counts):
            assert p not in found
            continue
        plan = [(order[k][0], i) for k, i in plain_schedule(counts)]
        base = sum(min(b, c * p) for _, c, b in order)
        assert found[p] == {t: (*x, base, sum(counts)) for t, x in enumerate(plan)}


def test_mixture_stays_within_one_block(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"hot": 2, "s0": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 3}
    found = sorted(mixing.mix(docs, weights, parts=18, block_rows=4).collect(), key=lambda r: r["position"])
    assert len(found) == 2000 and len({r["position"] for r in found}) == 2000
    slots = sorted({(r["slot"], r["source"]) for r in found})
    assert [s for s, _ in slots] == list(range(len(slots)))
    sizes = Counter(s for _, s in slots)
    whole = min(n // (2 * weights[s]) for s, n in sizes.items()) * 18  # slots before a source runs out
    assert whole >= 18
    seen = Counter()
    for t, source in slots[:whole]:
        seen[source] += 1
        assert all(abs(seen[s] - (t + 1) * w / 9) < 1 for s, w in weights.items())


def drifts(order, shares):
    """Largest distance of any source from its share after each slot, until one runs out."""
    left, seen = Counter(order), Counter()
    for t, source in enumerate(order, 1):
        seen[source] += 1
        yield max(abs(seen[s] - w * t) for s, w in shares.items())
        if seen[source] == left[source]:
            return


def test_exact_shares_of_many_sources():
    for weights in ([0.3, *[0.7 / 999] * 999], [math.sqrt(1 / 3), *[math.sqrt(2 / 57)] * 19], [2, 1, 1, 1, 1, 3]):
        shares = {k: w / math.fsum(weights) for k, w in enumerate(weights)}
        blocks = [math.ceil(20_000 * w) for w in shares.values()]
        found = list(mixing.slots(blocks, weights))
        assert Counter(k for k, _ in found) == dict(enumerate(blocks))
        assert max(drifts([k for k, _ in found], shares)) < 1
    order = [k for k, _ in mixing.slots([400, 3, 400, 5], [4, 2, 1, 0])]
    rest = [k for k in order if k in (0, 2)]
    assert order[-5:] == [3] * 5 and abs(rest[:400].count(0) - 320) < 2  # in proportion after source 1 ran out


def test_mix_meets_the_emitted_share(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 19}") for i in range(36_000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(36_000)) and len({r["position"] for r in found}) == 36_000
    slots = dict(sorted({r["slot"]: r["source"] for r in found}.items()))
    assert list(slots) == list(range(len(slots)))
    drift = list(drifts(list(slots.values()), {r["source"]: r["share"] for r in found}))
    assert len(drift) > 500 and max(drift) < 1


def test_sources_without_weight_come_last(spark):
    rows = [(i, f"s{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"s0": 0.3} | {f"s{k}": 0.7 / 298 for k in range(1, 299)}
    found = mixing.mix(docs, weights, block_rows=1).collect()
    last = [r["source"] for r in sorted(found, key=lambda r: r["position"])][-10:]
    assert set(last) == {"s299"} and {r["share"] for r in found if r["source"] == "s299"} == {0.0}
    assert {r["share"] for r in mixing.mix(docs, {}, block_rows=1).collect()} == {1 / 300}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": -1})


def test_mixing_edges(edge, nothing):
    found = mixing.mix(edge, block_rows=2).collect()
    assert len(found) == 12 and len({r["position"] for r in found}) == 12
    assert sorted(mixing.mixed(edge).columns) == sorted(c for c in edge.columns if c != "_position")
    assert mixing.mixed(edge).count() == 12
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


def plain_fit(items, capacity):
    """Tightest compatible bin by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in items:
        fit = [
            (b["room"], k)
            for k, b in enumerate(bins)
            if b["room"] >= length
            and (source is None or source not in b["sources"])
            and (cluster is None or cluster not in b["clusters"])
        ]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
            k = len(bins) - 1
        out.append((k, capacity - bins[k]["room"]))
        bins[k]["room"] -= length
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def test_best_fit_against_brute_force():
    draw = random.Random(8)
    for _ in range(30):
        items = [
            (draw.randrange(0, 101), draw.choice(["a", "a", "b", "c", None]), draw.choice([1, 2, 3, None, None, draw.random()]))
            for _ in range(80)
        ]
        bins, offsets = packing.best_fit(*zip(*items, strict=True), 100)
        assert list(zip(bins, offsets, strict=True)) == plain_fit(items, 100)


def test_pack_edges(edge, nothing):
    docs = edge.withColumn("cluster", F.xxhash64("text"))
    found = packing.pack(docs, 1000, 5, texts=True).collect()
    by_bin = defaultdict(list)
    for r in found:
        by_bin[r["bin"]].append(r)
        assert len(r["text"]) == r["length"]
    for rows in by_bin.values():
        rows.sort(key=lambda r: (r["offset"], r["length"]))
        assert sum(r["length"] for r in rows) <= 1000
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:]))
        sources = [r["source"] for r in rows if r["source"] is not None]
        assert len(set(sources)) == len(sources)
    want = Counter((r["doc_id"], (r["text"] or "")[k : k + 1000]) for r in edge.collect() for k in range(0, max(1, len(r["text"] or "")), 1000))
    assert Counter((r["doc_id"], r["text"]) for r in found) == want
    assert packing.pack(nothing.withColumn("cluster", F.lit(1)), 1000).count() == 0
