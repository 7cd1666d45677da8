"""Vectorised text primitives on whole Arrow batches: word hashes, shingle sets, n-gram buckets.

Texts are UTF-8 bytes; words are runs of anything but ``\\x20 \\x09-\\x0D``. All passes run over slices of about
``SLICE`` bytes so that a batch's temporaries stay bounded whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 17
_WINDOW = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _powers(step: int) -> np.ndarray:
    p = np.full(_WINDOW + 1, step, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_MUL = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about `most` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def _hash_span(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Polynomial hashes from prefix sums modulo 2**64, shifted back to each word's start."""
    base = int(starts[0])
    if int(ends[-1]) - base > _WINDOW:  # one word longer than the window
        word = buf[base : int(ends[-1])].tobytes()
        return np.array([xxhash.xxh3_64_intdigest(word.lower() if table is _FOLDED else word)], np.uint64)
    part = buf[base : int(ends[-1])]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(table[part] * _UP[: len(part)], out=sums[1:])
    at, to = starts - base, ends - base
    return mix((sums[to] - sums[at]) * _DOWN[at] + (to - at).astype(np.uint64) * _STEP)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased if `fold`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table, out, i = _FOLDED if fold else _BYTE, [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        out.append(_hash_span(buf, starts[i:j], ends[i:j], table))
        i = j
    return np.concatenate(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) > 1:
        first = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=first[1:])
        x = x[first]
    return x


def words_of(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the bounds of each text's words (len(texts) + 1)."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(buf)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return word_hashes(buf, starts, ends, fold), np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; fewer words count as one whole shingle."""
    for a, b in slices(texts):
        words, bound = words_of(texts[a:b])
        rolled = words[: max(0, len(words) - k + 1)] * _MUL[0]
        for i in range(1, k):
            rolled = rolled + words[i : len(words) - k + 1 + i] * _MUL[i]
        rolled = mix(rolled)
        for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield distinct(rolled[lo : hi - k + 1])
            elif hi > lo:
                short = (words[lo:hi] * _MUL[8 : 8 + hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
