"""Language identification with interpolated Kneser-Ney character models.

Texts are read as lower-case letters; every run of other characters is one
gap.  Symbols are UTF-16 units, so all letters are told apart (those beyond the
first plane are two symbols) and a gram of four is an exact 64-bit number: its
context and its suffix are shifts of it.  Grams of four are counted over all learning rows;
continuation counts of the shorter grams follow from the distinct longer ones.
For each order one sorted array of hashes serves all languages, with a column
of log-probabilities for each, so a position of a text takes one binary search.

The language with the lowest cross-entropy per character wins.  ``score`` is its
share in a softmax over the cross-entropies, ``rejected`` says that the
cross-entropy is higher than that of the share ``keep`` of the learning rows of that language.

Sizes: the model holds every gram that was counted, however rare; it is
broadcast and has a number for each language and distinct gram.  These grow much
slower than the corpus where letters are few.  Counts and calibration cover every
learning row; besides the distinct grams, one row for each language comes to the
driver.

Defined results: null text, or text without a letter, is ``und`` with score 0;
rows without a language are not learned from; ties go to the first language in
order; with no learning rows everything is ``und``; repeated rows score alike;
columns that have the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrid.llm import text as T
from lexigrid.session import staged

ORDER, BITS = 4, 16
SYMBOLS = 1 << BITS
SHIFT = np.uint64(BITS)
HEATS = tuple(2.0**k for k in range(-1, 7))
RANKS = 100_000  # a limit is off by one of so many ranks at most; exact for fewer rows


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (BITS * order)) - 1)


def _units(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as UTF-16 units, and the offsets among them."""
    far = codes > 0xFFFF
    if not far.any():
        return codes, offsets
    at = np.concatenate([[0], np.cumsum(1 + far)])
    out = np.empty(at[-1], codes.dtype)
    out[at[:-1]] = np.where(far, 0xD800 + ((codes - 0x10000) >> 10), codes)
    out[at[:-1][far] + 1] = 0xDC00 + ((codes[far] - 0x10000) & 0x3FF)
    return out, at[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram at every position of a chunk, bounds of documents, letters of each."""
    codes = symbols[points]
    letters = T.sums(codes > 0, offsets).astype(np.int64)
    codes, offsets = _units(codes, offsets)
    gap = codes == 0
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True
    kept = ~(gap & np.r_[False, gap[:-1]]) | first[:-1]
    moved = np.concatenate([[0], np.cumsum(kept)])
    bounds = moved[offsets]
    codes = codes[kept].astype(np.uint64)
    n = len(codes)
    found = codes.copy()
    starts = bounds[:-1]
    for back in range(1, ORDER):
        earlier = np.concatenate([np.zeros(min(back, n), np.uint64), codes[: n - back]]) if n > back else np.zeros(n, np.uint64)
        for k in range(back):  # nothing lies before a document
            at = np.minimum(starts + k, bounds[1:])
            earlier[at[at < bounds[1:]]] = 0
        found |= earlier << np.uint64(BITS * back)
    return found, bounds, letters


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Level:
    """Counts of one order in one language, as discounted shares."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        self.codes = codes
        self.contexts, where = np.unique(codes >> SHIFT, return_inverse=True)
        totals = np.bincount(where, counts, len(self.contexts))
        self.share = np.maximum(counts - discount, 0) / totals[where]
        self.rest = np.bincount(where, np.minimum(counts, discount), len(self.contexts)) / totals

    def of(self, codes: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probability of ``codes``, given that of their suffixes."""
        at, seen = _find(self.contexts, codes >> SHIFT)
        rest = np.where(seen, self.rest[at] if len(self.rest) else 1, 1.0)
        at, seen = _find(self.codes, codes)
        return np.where(seen, self.share[at] if len(self.share) else 0, 0.0) + rest * lower


def _levels(codes: np.ndarray, counts: np.ndarray) -> list[_Level]:
    """Levels of one language from the shortest to the longest gram."""
    found = [_Level(codes, counts.astype(np.float64))]
    for order in range(ORDER - 1, 0, -1):
        codes, continuations = np.unique(codes & _mask(order), return_counts=True)
        found.append(_Level(codes, continuations.astype(np.float64)))
    return found[::-1]


@cache
def _symbols() -> np.ndarray:
    """The lower-case letter by code point, 0 for what is no letter."""
    return np.where(T.letters(), T.lower(), 0).astype(np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    singles: np.ndarray  # log-probability of every symbol, a column for each language
    keys: tuple[np.ndarray, ...]  # grams of orders 2 to 4
    values: tuple[np.ndarray, ...]  # their log-probabilities
    contexts: tuple[np.ndarray, ...]  # contexts of orders 2 to 4
    rests: tuple[np.ndarray, ...]  # their log back-off weights
    heat: float = 1.0
    limits: dict[str, float] = field(default_factory=dict)

    def codes(self) -> np.ndarray:
        """Symbol by code point."""
        return _symbols()

    def _log(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order == 1:
            return self.singles[codes.astype(np.int64)]
        level = order - 2
        at, seen = _find(self.keys[level], codes)
        found = self.values[level][at] if len(self.keys[level]) else np.zeros((len(codes), len(self.languages)), np.float32)
        missed = np.flatnonzero(~seen)
        if len(missed):
            lost = codes[missed]
            at, seen = _find(self.contexts[level], lost >> SHIFT)
            rest = self.rests[level][at] * seen[:, None] if len(self.contexts[level]) else 0
            found[missed] = rest + self._log(lost & _mask(order - 1), order - 1)
        return found

    def entropies(self, texts: pa.Array, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per position for each language, and letters, of each text."""
        out, many = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for at, points, offsets in T.chunks(texts):
            n = len(offsets) - 1
            found, bounds, letters = grams(points, offsets, symbols)
            total = T.sums(self._log(found, ORDER), bounds)
            out[at : at + n] = -total / np.maximum(1, bounds[1:] - bounds[:-1])[:, None]
            many[at : at + n] = letters
        return out, many


def estimate(languages: tuple[str, ...], counted: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model from sorted grams and counts of each language."""
    by_language = [_levels(c, n) for c, n in counted]
    orders = range(2, ORDER + 1)
    union = {k: np.unique(np.concatenate([lv[k - 1].codes for lv in by_language])) for k in orders}
    contexts = {k: np.unique(np.concatenate([lv[k - 1].contexts for lv in by_language])) for k in orders}
    tables: dict[int, list[np.ndarray]] = {k: [] for k in range(1, ORDER + 1)}
    rests: dict[int, list[np.ndarray]] = {k: [] for k in orders}
    for lv in by_language:
        tables[1].append(lv[0].of(np.arange(SYMBOLS, dtype=np.uint64), np.full(SYMBOLS, 1 / SYMBOLS)))

        def share(codes: np.ndarray, order: int, lv=lv) -> np.ndarray:
            if order == 1:
                return tables[1][-1][codes.astype(np.int64)]
            return lv[order - 1].of(codes, share(codes & _mask(order - 1), order - 1))

        for k in orders:
            tables[k].append(share(union[k], k))
            at, seen = _find(lv[k - 1].contexts, contexts[k])
            rests[k].append(np.where(seen, lv[k - 1].rest[at], 1.0))

    def log(columns: list[np.ndarray]) -> np.ndarray:
        return np.log(np.maximum(np.stack(columns, 1), 1e-300)).astype(np.float32)

    return LanguageModel(
        languages, log(tables[1]), tuple(union.values()), tuple(log(tables[k]) for k in orders),
        tuple(contexts.values()), tuple(log(rests[k]) for k in orders),
    )


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    texts, names = batch.column("text"), batch.column("lang")
    for name in names.unique().to_pylist():
        yield name, texts.filter(pa.compute.equal(names, name))


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, where = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def _rows(by: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for name, (codes, counts) in by.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
            names=["lang", "code", "n"],
        )


_COUNTS = "lang string, code long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, code, n``: grams over the batches of a task."""
    symbols = _symbols()
    parts: dict[str, tuple[list, list]] = {}
    for batch in batches:
        for name, texts in _by_language(batch):
            codes, counts = parts.setdefault(name, ([], []))
            for _, points, offsets in T.chunks(texts):
                found, _, _ = grams(points, offsets, symbols)
                for x, y in zip((codes, counts), np.unique(found, return_counts=True), strict=True):
                    x.append(y)
                if len(codes) > 16:
                    parts[name] = codes, counts = tuple([x] for x in _merged(codes, counts))
    yield from _rows({name: _merged(*found) for name, found in parts.items()})


def fit(docs: DataFrame, keep: float = 0.999) -> LanguageModel | None:
    """Learn from ``docs(doc_id, text, lang)``; None if nothing can be learned."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counted = known.select("text", "lang").mapInArrow(_count, _COUNTS).groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not pa.compute.any(pa.compute.not_equal(counted["code"], 0)).as_py():  # no row, or no letter
        return None
    languages = tuple(sorted(counted["lang"].unique().to_pylist()))
    tables = []
    for name in languages:
        own = counted.filter(pa.compute.equal(counted["lang"], name))
        codes, counts = own["code"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(codes)
        tables.append((codes[order], counts[order]))
    return _calibrated(known, estimate(languages, tables), keep)


def _calibrated(known: DataFrame, model: LanguageModel, keep: float) -> LanguageModel:
    """The heat with the least loss and the limit of each language, over every learning row with a letter."""
    true = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang"))
    found = _measured(known.select("text", "lang"), model).where("_letters > 0")
    found = found.select("lang", F.get("_h", (true - 1).cast("int")).alias("_own"), "_h", F.array_min("_h").alias("_low"))

    def loss(heat: float) -> Column:
        mass = F.aggregate("_h", F.lit(0.0), lambda a, h: a + F.exp((F.col("_low") - h) * heat))
        return heat * (F.col("_own") - F.col("_low")) + F.log(mass)

    rows = staged(found.select("lang", "_own", *[loss(h).alias(f"_{i}") for i, h in enumerate(HEATS)]), "measured")
    by = rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(HEATS))])
    by = by.collect()  # one for each language
    if not by:
        return model
    total = [sum(r[f"_{i}"] for r in by) for i in range(len(HEATS))]
    # the limit lies between two neighbours in rank
    at = {r["lang"]: divmod((r["n"] - 1) * keep, 1) for r in by}
    pairs = {r["lang"]: [(min(at[r["lang"]][0] + k, r["n"] - 1) + 0.5) / r["n"] for k in (0, 1)] for r in by}
    own = [F.percentile_approx(F.when(F.col("lang") == name, F.col("_own")), two, RANKS) for name, two in pairs.items()]
    ends = dict(zip(pairs, rows.agg(*own).first(), strict=True))
    limits = {name: low + (high - low) * at[name][1] for name, (low, high) in ends.items()}
    return LanguageModel(**{**model.__dict__, "heat": HEATS[int(np.argmin(total))], "limits": limits})


def _measured(docs: DataFrame, model: LanguageModel) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        symbols = model.codes()
        for batch in batches:
            h, letters = model.entropies(batch.column("text"), symbols)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(letters)], names=[*batch.schema.names, "_h", "_letters"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(measure, f"{fields}, _h array<double>, _letters long")


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    docs = docs.drop("lang_pred", "score", "rejected", "_h", "_letters", "_low")
    names = F.array(*map(F.lit, model.languages))
    low = F.array_min("_h")
    known = F.col("text").isNotNull() & (F.col("_letters") > 0)
    mass = F.aggregate("_h", F.lit(0.0), lambda a, h: a + F.exp((low - h) * model.heat))
    limit = F.create_map(*[F.lit(x) for kv in model.limits.items() for x in kv]) if model.limits else F.lit(None)
    best = F.try_element_at(names, F.array_position("_h", low).cast("int"))
    out = _measured(docs, model).withColumns(
        {
            "lang_pred": F.when(known, best).otherwise("und"),
            "score": F.when(known, 1 / mass).otherwise(0.0),
            "_low": low,
        }
    )
    over = (F.col("_low") > F.coalesce(limit[F.col("lang_pred")], F.lit(float("inf")))) if model.limits else F.lit(False)
    return out.withColumn("rejected", (F.col("lang_pred") == "und") | over).drop("_h", "_letters", "_low")
