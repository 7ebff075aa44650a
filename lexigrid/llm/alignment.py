"""Alignment of two tokenizers: which tokens of A and of B cover the same bytes, and how usual that is.

A text is encoded by both tokenizers and both token sequences become lists of
end offsets in bytes.  Where both lists have an offset they are cut, so a group
is the shortest run of A tokens and of B tokens over the same bytes.

* **Galloping intersection.**  For each document the shorter list drives.  Each
  of its ends starts where its rank points to in the longer list, steps out in
  doubled steps until it is enclosed, and is found by binary search in between.
  The indices found cut the groups, their differences are the numbers of A and B
  tokens in a group, and these the links: every A token with every B token.
  All documents of a run gallop at once, as array operations.
* **Links.**  By document, links are kept as distinct pairs of ids with how often
  they occur, never as occurrences.
* **Counts.**  A pair counts once for each document; partitions are summed before
  the shuffle.  The best count of an A id is one number for each entry of A.
* **Look-up.**  The most frequent pairs, ``HELD`` at most, go to the tasks as sorted
  arrays; those are all of them unless the corpus has more.  The other pairs are
  rare by definition, so their rows meet the counts by an even shuffle.  Every
  document gets whole numbers either way.

Texts are encoded once.  The merges of A, if its ids are in their order (checked
when the file is read), are also given to an encoder by ranks, which is six
times as fast; it takes the texts of which both surely make the same.  The
tokenizer files must lie at the same path on every machine; they are read once
in a worker.  Nothing but the held pairs is collected.

Defined results: texts that are null or empty, or that a tokenizer does not give
back byte by byte, have no tokens: zeros and an empty digest.  Strings of special
tokens are plain text.  Repeated rows are each a result row and each count as a
document, ids may be null, and an empty table gives no rows.  Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexigrid.llm import raw
from lexigrid.session import staged

HELD = 1 << 22  # pairs of 17 bytes
LINKS = 1 << 21  # links that are expanded at once
KEPT = 1 << 22  # pairs that are held before they are summed
_ROW_BITS = 40


@dataclass(frozen=True)
class Side:
    """Bytes of the tokens of one tokenizer, by id."""

    tokens: list[bytes]
    sizes: np.ndarray


def _side(tokens: list[bytes]) -> Side:
    return Side(tokens, np.array([len(t) for t in tokens], np.int64))


def byte_of_symbol() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: visible Latin-1 as it is, the others from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: Fixed value: how byte-level tokenizers split a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_level(path: str):
    """Tokenizer A, an encoder by the ranks of its merges if they allow one, and its tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    symbols = byte_of_symbol()
    tokens = [b""] * tokenizer.get_vocab_size()
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    for token, i in tokenizer.get_vocab().items():
        known = all(c in symbols for c in token)
        tokens[i] = bytes(symbols[c] for c in token) if known else token.encode()
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    first = len(tokens) - len(special) - len(merges)
    split = told["pre_tokenizer"] or {}
    ranked = None
    if (
        first == 256 and not told["normalizer"] and split.get("type") == "ByteLevel"
        and split.get("use_regex") and not split.get("add_prefix_space")
        and all(told["model"]["vocab"].get(a + b) == first + i for i, (a, b) in enumerate(merges))
    ):
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        ranked = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return tokenizer, ranked, _side(tokens)


@cache
def pieces(path: str):
    """Tokenizer B and its tokens."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, _side(tokens)


def gallop(keys: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """First place in ``longer[low:high]`` whose value is not below the key; ``longer[high - 1]`` is not."""
    lo, hi = guess.copy(), guess.copy()  # longer[lo - 1] < key <= longer[hi] when done
    step = np.ones(len(keys), np.int64)
    active = np.flatnonzero(longer[guess] < keys)
    lo[active] += 1
    while len(active):
        hi[active] = np.minimum(guess[active] + step[active], high[active] - 1)
        active = active[longer[hi[active]] < keys[active]]
        lo[active] = hi[active] + 1
        step[active] *= 2
    step[:] = 1
    active = np.flatnonzero((longer[guess] >= keys) & (guess > low))
    while len(active):
        lo[active] = np.maximum(guess[active] - step[active], low[active])
        below = longer[lo[active]] < keys[active]
        lo[active[below]] += 1
        active = active[~below]
        hi[active] = lo[active]
        active = active[lo[active] > low[active]]
        step[active] *= 2
    active = np.flatnonzero(lo < hi)
    while len(active):
        middle = (lo[active] + hi[active]) >> 1
        below = longer[middle] < keys[active]
        lo[active[below]] = middle[below] + 1
        hi[active[~below]] = middle[~below]
        active = active[lo[active] < hi[active]]
    return lo


def common_ends(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and in ``b`` of the ends both have; bounds are those of documents, whose last ends are equal."""
    n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
    found = []
    for short, s_bounds, n_s, long, l_bounds, n_l, drives in (
        (a, a_bounds, n_a, b, b_bounds, n_b, n_a <= n_b), (b, b_bounds, n_b, a, a_bounds, n_a, n_a > n_b),
    ):
        docs = np.repeat(np.arange(len(n_s)), np.where(drives, n_s, 0))
        mine = np.flatnonzero(np.repeat(drives, n_s))
        rank = mine - s_bounds[docs]
        low, high = l_bounds[docs], l_bounds[docs + 1]
        place = gallop(short[mine], low + rank * n_l[docs] // n_s[docs], low, high, long)
        met = long[place] == short[mine]
        found.append((mine[met], place[met]))
    (in_a, in_b), (other_b, other_a) = found
    return np.sort(np.concatenate([in_a, other_a])), np.sort(np.concatenate([in_b, other_b]))


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    texts = [str(i).encode() for i in range(n)]
    width = len(texts[-1])
    return np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(n, width), np.array([len(t) for t in texts])


def written(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text ``a1,a2|b1;...;`` and the places in it after each token, A and B of a group in turn."""
    digits, sizes = _decimals(vocabulary)
    n_a, n_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    marks = np.full(len(ids), ord(","), np.uint8)
    marks[at_a[in_a]], marks[at_b[in_b]] = ord("|"), ord(";")
    lengths = sizes[ids]
    ends = np.cumsum(lengths + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - lengths - 1
    for k in range(digits.shape[1]):
        has = lengths > k
        out[starts[has] + k] = digits[ids[has], k]
    out[ends - 1] = marks
    return out, np.concatenate([[0], ends])


def pairs(
    a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, group_bounds: np.ndarray, size_a: int, size_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links by document: ``(document, a * size_b + b, times)``, sorted; links are expanded ``LINKS`` at a time."""
    n_a, n_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
    after = np.cumsum(n_a * n_b)
    total = int(after[-1]) if len(after) else 0
    codes = size_a * size_b
    first = np.repeat(np.arange(len(group_bounds) - 1), np.diff(group_bounds)) * codes  # of the document of a group
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for begin in range(0, total, LINKS):
        link = np.arange(begin, min(total, begin + LINKS))
        low, high = np.searchsorted(after, (begin, link[-1]), "right")
        spans = np.diff(np.clip(after[low : high + 1], begin, begin + len(link)), prepend=begin)
        group = np.repeat(np.arange(low, high + 1), spans)
        inside = link - (after[group] - n_a[group] * n_b[group])
        of_a, of_b = in_a[group] - n_a[group] + 1, in_b[group] - n_b[group] + 1
        if len(link) > 2 * len(spans):  # else nearly all groups are one token each
            of_a += inside // n_b[group]
            of_b += inside % n_b[group]
        else:
            many = np.flatnonzero(inside)
            of_a[many] += inside[many] // n_b[group[many]]
            of_b[many] += inside[many] % n_b[group[many]]
        parts.append(np.unique(first[group] + a[of_a] * size_b + b[of_b], return_counts=True))
        if sum(len(p[0]) for p in parts) > 4 * LINKS:
            parts = [summed(parts)]
    keys, times = summed(parts)
    return keys // codes, keys % codes, times


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers; the keys of a part are distinct and sorted."""
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, numbers = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(numbers, starts) if len(starts) else numbers


#: A run that is one piece to the pattern may be this long in texts that go to the rank encoder, whose time grows with its square.
_LONG = re.compile("[^ ]{500}| {500}")


def _settled(text: str) -> bool:
    """True if every version of Unicode splits the text alike, and no piece of it is very long."""
    try:
        text.encode("cp1252")
    except UnicodeEncodeError:
        return False
    return not _LONG.search(text)


class Aligner:
    """Both tokenizers, and what they make of a run of texts."""

    def __init__(self, byte_path: str, piece_path: str):
        (self.byte_level, self.ranked, self.a), (self.pieces, self.b) = byte_level(byte_path), pieces(piece_path)
        self.vocabulary = max(len(self.a.tokens), len(self.b.tokens))

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        """Ids by A: from its ranks where that is sure to be the same, else from the tokenizer itself."""
        found = [self.ranked.encode_ordinary(t) if self.ranked and _settled(t) else None for t in texts]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.byte_level.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Places of the texts that both tokenizers give back, ids of A and of B, and how many each text has."""
        full = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in full]
        good, kept = [], ([], [])
        for i, whole, *ids in zip(full, spaced, self._ids_a(spaced), self.pieces.encode([texts[i] for i in full], num_threads=1), strict=True):
            whole = whole.encode()
            if all(b"".join(map(s.tokens.__getitem__, x)) == whole for s, x in zip((self.a, self.b), ids)):
                good.append(i)
                for k, x in zip(kept, ids):
                    k.append(np.array(x, np.int64))
        none = np.zeros(0, np.int64)
        counts = [np.array([len(x) for x in k], np.int64) for k in kept]
        return np.array(good, np.int64), [np.concatenate([none, *k]) for k in kept], counts

    def rows(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        """Numbers, digests and distinct links of the texts, as columns."""
        n = len(texts)
        docs, (a, b), counts = self.encoded(texts)
        a_bounds, b_bounds = (np.concatenate([[0], np.cumsum(c)]) for c in counts)
        in_a, in_b = common_ends(np.cumsum(self.a.sizes[a]), a_bounds, np.cumsum(self.b.sizes[b]), b_bounds)
        groups = np.searchsorted(in_a, a_bounds)
        text, places = written(a, b, in_a, in_b, self.vocabulary)
        cuts = places[a_bounds + b_bounds]
        digests = [""] * n
        for i, start, end in zip(docs, cuts[:-1], cuts[1:], strict=True):
            digests[i] = hashlib.sha256(text[start : end - 1]).hexdigest()
        owner, code, times = pairs(a, b, in_a, in_b, groups, len(self.a.tokens), len(self.b.tokens))

        def placed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[docs] = values
            return out

        links = np.bincount(owner, times, len(docs)).astype(np.int64)
        return {
            "n_a": placed(counts[0]), "n_b": placed(counts[1]), "n_groups": placed(np.diff(groups)), "n_links": placed(links),
            "groups_sha256": digests, "of": np.concatenate([[0], np.cumsum(placed(np.bincount(owner, minlength=len(docs))))]),
            "a": code // len(self.b.tokens), "b": code % len(self.b.tokens), "times": times,
        }


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_LINKS = ("a", "b", "times")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its numbers, the digest of its groups and its distinct links (``a, b, times``, arrays)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << _ROW_BITS
        for batch in batches:
            column = batch.column("text")
            for at, _, offsets in raw.chunks(column):
                n = len(offsets) - 1
                made = aligner.rows(column.slice(at, n).to_pylist())
                of = pa.array(made["of"].astype(np.int32))
                columns = [pa.array(row + np.arange(n)), batch.column("doc_id").slice(at, n)]
                columns += [pa.array(made[c]) for c in (*_NUMBERS, "groups_sha256")]
                columns += [pa.ListArray.from_arrays(of, pa.array(made[c].astype(np.int32))) for c in _LINKS]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", *_NUMBERS, "groups_sha256", *_LINKS])
                row += n

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    links = ", ".join(f"{c} array<int>" for c in _LINKS)
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(walk, f"row long, doc_id {kind}, {numbers}, groups_sha256 string, {links}")


def _flat(batch: pa.RecordBatch, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, code, times)`` of the links of a batch."""
    a, b, times = (batch.column(c) for c in _LINKS)
    owners = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64))
    code = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) * size_b + b.flatten().to_numpy(zero_copy_only=False)
    return owners, code, times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """``code, n, best``: documents that hold a pair linked, and whether that is the most of its A id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            _, code, _ = _flat(batch, size_b)
            parts.append(np.unique(code, return_counts=True))
            if sum(len(p[0]) for p in parts) > KEPT:
                parts = [summed(parts)]
                if len(parts[0][0]) > KEPT // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["code", "n"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(parts)], names=["code", "n"])

    counted = links.select(*_LINKS).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = staged(counted, "pairs")
    id = F.floor(F.col("code") / size_b).alias("_a")
    most = counted.groupBy(id).agg(F.max("n").alias("_most"))  # a row for each entry of A's vocabulary at most
    return counted.withColumn("_a", id).join(F.broadcast(most), "_a").select("code", "n", (F.col("n") == F.col("_most")).alias("best"))


def _cut(counts: DataFrame, held: int) -> int:
    """Least count of the pairs that go to the tasks: a power of two, so that at most ``held`` pairs have it."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()  # 64 rows at most
    total, cut = 0, 1 << 62
    for r in sizes:
        total += r["count"]
        if total > held:
            return cut
        cut = 1 << r["k"]
    return 0


def scored(rows: DataFrame, counts: DataFrame, size_b: int, held: int = HELD) -> DataFrame:
    """``rows`` (staged) with ``n_best`` and ``count_sum`` in place of the links."""
    cut = _cut(counts, held)
    table = counts.where(F.col("n") >= cut).toArrow().sort_by("code")
    shared = rows.sparkSession.sparkContext.broadcast([table[c].to_numpy() for c in ("code", "n", "best")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of, n_of, best_of = shared.value
        for batch in batches:
            owners, code, times = _flat(batch, size_b)
            place = np.minimum(np.searchsorted(code_of, code), max(0, len(code_of) - 1))
            here = code_of[place] == code if len(code_of) else np.zeros(len(code), bool)
            known = place[here]
            rare = [0, *np.cumsum(np.bincount(owners[~here], minlength=batch.num_rows))]
            best = _sums(owners[here], np.where(best_of[known], times[here], 0), batch.num_rows)
            total = _sums(owners[here], times[here] * n_of[known], batch.num_rows)
            of = pa.array(rare, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(best), pa.array(total),
                 pa.ListArray.from_arrays(of, pa.array(code[~here])), pa.ListArray.from_arrays(of, pa.array(times[~here]))],
                names=["row", "n_best", "count_sum", "rare", "rare_times"],
            )

    schema = "row long, n_best long, count_sum long, rare array<bigint>, rare_times array<bigint>"
    sums = staged(rows.select("row", *_LINKS).mapInArrow(add, schema), "sums")
    shared.destroy()
    parts = sums.select("row", "n_best", "count_sum")
    if cut:
        rare = sums.select("row", F.inline(F.arrays_zip(F.col("rare").alias("code"), F.col("rare_times").alias("times"))))
        rare = rare.join(counts.where(F.col("n") < cut), "code")
        parts = parts.unionByName(rare.select(
            "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
        ))
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop(*_LINKS).join(parts.hint("shuffle_hash"), "row")


def _sums(owners: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by owner, owners sorted."""
    after = np.concatenate([[0], np.cumsum(values)])
    bounds = np.searchsorted(owners, np.arange(n + 1))
    return after[bounds[1:]] - after[bounds[:-1]]


def align(docs: DataFrame, byte_path: str, piece_path: str, id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` for every row of ``docs``."""
    rows = staged(aligned(docs, byte_path, piece_path, id, text), "aligned")
    size_b = len(pieces(piece_path)[1].tokens)
    counts = staged(pair_counts(rows, size_b), "counts")
    return scored(rows, counts, size_b, held).drop("row")
