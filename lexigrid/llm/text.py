"""Texts of an Arrow batch as flat NumPy arrays: code points, tokens, hashes.

Everything here works on whole texts.  A batch is cut into chunks of documents
so that the arrays of one chunk stay small; a single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 18
SLICE_BYTES = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLANES = 0x20000  # classes are tabulated to here; letters beyond are ideographs
_powers: dict[int, np.ndarray] = {}

SPACE, WORD, MARK = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one to one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` for ``i < n`` modulo 2**64; kept and grown by need."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_CHARS + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


@cache
def char_classes() -> np.ndarray:
    """``SPACE``, ``WORD`` (letters, digits) or ``MARK`` by code point."""
    found = np.full(0x110000, WORD, np.uint8)
    found[:_PLANES] = [WORD if (c := chr(i)).isalnum() else SPACE if c.isspace() or i < 32 else MARK for i in range(_PLANES)]
    found[0xE0000:] = MARK
    return found


@cache
def letters() -> np.ndarray:
    """True where a code point is a letter."""
    found = np.zeros(0x110000, bool)
    found[:_PLANES] = [chr(i).isalpha() for i in range(_PLANES)]
    found[_PLANES:0xE0000] = True
    return found


@cache
def lower() -> np.ndarray:
    """Lower case by code point, where that is one code point."""
    found = np.arange(0x110000, dtype=np.uint32)
    found[:_PLANES] = [ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(_PLANES)]
    return found


def chunks(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, code points, offsets)`` of runs of documents.

    Null texts count as empty.  A run has about ``limit`` code points; a longer
    text is a run of its own.
    """
    rows = texts.to_pylist() if len(texts) < 2 else None
    sizes = pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        part = rows[at:to] if rows is not None else texts.slice(at, to - at).to_pylist()
        flat = "".join(t or "" for t in part).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(flat, np.uint32), np.concatenate([[0], ends[at:to] - base]).astype(np.int64)
        at = to


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(
    points: np.ndarray, offsets: np.ndarray, marks: bool = False, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """Tokens of a chunk: ``(hash, start, document)``, and one more hash array for each of ``stems``.

    A token is a run of letters and digits, in lower case, or, with ``marks``,
    a run of other visible characters.  Equal tokens have equal hashes wherever
    they stand.  A stem is the first so many characters.
    """
    if not len(points):
        none = np.zeros(0, np.int64)
        return (none.astype(np.uint64), none, none, *[none.astype(np.uint64)] * len(stems))
    kinds = char_classes()[points]
    if not marks:
        kinds = (kinds == WORD).view(np.uint8)
    change = np.empty(len(points) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    kept = kinds[starts] != SPACE
    starts, ends = starts[kept], ends[kept]
    summed = np.empty(len(points) + 1, np.uint64)
    summed[0] = 0
    np.cumsum((lower()[points].astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(points)), out=summed[1:])
    scale = powers(_INVERSE, len(points))[starts]
    hashes = mix((summed[ends] - summed[starts]) * scale)
    short = [mix((summed[np.minimum(ends, starts + k)] - summed[starts]) * scale + np.uint64(k)) for k in stems]
    return hashes, starts, np.searchsorted(offsets, starts, "right") - 1, *short


def spans(owners: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the items of each of ``n`` documents, given sorted owners."""
    return np.searchsorted(owners, np.arange(n + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each span of ``offsets``; empty spans give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
