"""Texts of an Arrow batch as flat arrays of UTF-8 bytes, without Python strings.

Words by a rule on ASCII characters need no decoding: every byte of a character
beyond ASCII is 0x80 or more.  A batch is walked in runs of documents of bounded
bytes; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexigrid.llm import text as T

CHUNK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: ``A-Z`` as ``a-z``; every other byte is itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of runs of documents; null texts count as empty.

    A run has at most ``limit`` bytes; a longer text is a run of its own.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    size = 8 if wide else 4
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * size).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and ends[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, flat[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of the words of a run: maximal runs of bytes that ``is_word`` marks.

    The words of document ``d`` are ``bounds[d]`` to ``bounds[d + 1]``.  Equal
    words have equal hashes wherever they stand.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    kept = inside[edges[:-1]]
    starts, ends = edges[:-1][kept], edges[1:][kept]
    summed = np.empty(len(data) + 1, np.uint64)
    summed[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * T.powers(_BASE, len(data)), out=summed[1:])
    hashes = T.mix((summed[ends] - summed[starts]) * T.powers(_INVERSE, len(data))[starts])
    return hashes, np.searchsorted(starts, offsets)
