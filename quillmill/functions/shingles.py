"""Vectorised character n-grams: many texts in one array, hashed by rolling and made distinct by one sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Characters of text that one vectorised step holds; batches are cut into steps of about this size.
STEP_CHARS = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A key has the text's number in its upper bits and a hash in the lower HASH_BITS.
HASH_BITS = 44
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters each; a longer text makes a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in one array, and where each text starts (one more entry at the end)."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lens)])


def rolling(points: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``width`` code points from each position (shorter at the very end)."""
    wide = points.astype(np.uint64)
    wide += np.uint64(1)
    h = np.zeros(len(points), np.uint64)
    for k in range(width):
        h *= _M1
        h[: max(len(points) - k, 0)] += wide[k:]
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def pieces(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, n-gram) keys of a step and the first key of each text.

    A text shorter than ``width`` is one n-gram; an empty text has none."""
    points, at = code_points(texts)
    lens = np.diff(at)
    h = rolling(points, width) if len(points) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lens)
    ok = np.ones(len(points), bool)
    for k in range(1, width):
        ends = at[1:] - k
        ok[ends[lens >= k]] = False
    for i in np.nonzero((lens > 0) & (lens < width))[0]:
        ok[at[i]] = True
        h[at[i]] = np.uint64(xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass")))
    keys = (doc[ok] << np.uint64(HASH_BITS)) | (h[ok] >> np.uint64(64 - HASH_BITS))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(HASH_BITS))


def shared_counts(left: list[str], right: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each pair of texts: in the left, in the right, in both."""
    n = len(left)
    keys, at = pieces([*left, *right], width)
    sizes = np.diff(at)
    pair = (np.repeat(np.arange(2 * n), sizes) % max(n, 1)).astype(np.uint64)
    merged = (pair << np.uint64(HASH_BITS)) | (keys & HASH_MASK)
    merged.sort()
    twice = merged[1:][merged[1:] == merged[:-1]] >> np.uint64(HASH_BITS)
    return sizes[:n], sizes[n:], np.bincount(twice.astype(np.int64), minlength=n)
