"""Exact join of two sides of texts on their sets of pieces, block by block.

Sets of n and m pieces of which a share of ``threshold`` is common have ``threshold / (1 + threshold) * (n + m)``
common pieces at least. All pieces stand in one order, rare ones first. The first ``MEET`` common pieces of such a pair
(all of them, if it needs fewer) stand so early in both sets that enough pieces are left from each on: a pair has so
many pieces of both prefixes in common, or it is none. Nothing is estimated and no pair is lost. The order decides the
speed only; it comes from the counts of a sample.

Pairs that meet are compared by parity: each piece flips one bit of its text, so two texts differ in as many pieces at
least as in bits. What is left is verified on the whole sets.

Defined results: a text shorter than a piece is one piece; an empty side gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

from quillmill.functions.shingles import HASH_BITS, HASH_MASK, pieces, shared_counts, steps

#: Counters of the piece counts, and texts of the sample that they count.
COUNTER_BITS, SAMPLE = 22, 20_000
#: Common pieces of the prefixes that a pair must have: more make prefixes longer and candidates fewer.
MEET = 12
#: Matches that one step holds, and words of parity that one comparison holds.
STEP_MATCHES, STEP_WORDS = 500_000, 1_000_000
#: Bits of a piece's level, and texts of which the number fits above level and hash.
LEVEL_BITS, TEXTS = 8, 1 << 12
#: Parity bits that a text has at least (their logarithm).
LEAST_WIDE = 8
_RANK = np.uint64((1 << (HASH_BITS + LEVEL_BITS)) - 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def levels_of(batches: Iterator[pd.DataFrame], width: int = 5) -> Iterator[pd.DataFrame]:
    """One row: the logarithm of the count of each counter, a byte each."""
    total = np.zeros(1 << COUNTER_BITS, np.int32)
    for b in batches:
        forms = list(b["form"])
        for lo, hi in steps(forms):
            np.add.at(total, (pieces(forms[lo:hi], width)[0] & np.uint64(len(total) - 1)).astype(np.int64), 1)
    yield pd.DataFrame({"levels": [np.minimum(8 * np.log2(1 + total.astype(np.float32)), 255).astype(np.uint8).tobytes()]})


def share_of(threshold: float) -> float:
    """Common pieces of a pair at the threshold, as a share of the sum of the sizes."""
    return threshold / (1 + threshold)


def size_class(sizes: np.ndarray) -> np.ndarray:
    """The logarithm of the smallest power of two that is no smaller than each size."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


class Ordered(NamedTuple):
    """Texts as their sizes, the ranks of their prefixes (one after another, ``at`` where each starts), and their parity
    words (``word_at`` likewise)."""

    sizes: np.ndarray
    ranks: np.ndarray
    at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray


def ordered(forms: list[str], levels: np.ndarray, threshold: float, spare: int, width: int = 5) -> Ordered:
    """``spare``: parity bits are 2 ** (size class + spare), and 2 ** LEAST_WIDE at least."""
    sizes, ranks, kept, words, wide = [], [], [], [], []
    for start, end in steps(forms):
        for lo in range(start, end, TEXTS):
            keys, at = pieces(forms[lo : min(lo + TEXTS, end)], width)
            size, hashes = np.diff(at), keys & HASH_MASK
            level = levels[(hashes & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
            ranked = np.sort((keys >> np.uint64(HASH_BITS) << np.uint64(HASH_BITS + LEVEL_BITS)) | (level << np.uint64(HASH_BITS)) | hashes)
            keep = np.minimum(size, size - np.ceil(threshold * size - 1e-6).astype(np.int64) + MEET)
            ranks.append(ranked[np.arange(len(ranked)) - np.repeat(at[:-1], size) < np.repeat(keep, size)] & _RANK)
            w = np.maximum(size_class(size) + spare, LEAST_WIDE)
            bit_at = np.concatenate([[0], np.cumsum(np.int64(1) << w)])
            spot = (((hashes * _SPREAD) >> np.uint64(24)) & np.repeat((np.uint64(1) << w.astype(np.uint64)) - np.uint64(1), size)).astype(np.int64)
            flips = np.bincount(spot + np.repeat(bit_at[:-1], size), minlength=int(bit_at[-1])) & 1
            words.append(np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64))
            sizes.append(size), kept.append(keep), wide.append(w)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    starts = lambda n: np.concatenate([[0], np.cumsum(n)])
    return Ordered(join(sizes, np.int64), join(ranks, np.uint64), starts(join(kept, np.int64)), join(words, np.uint64), starts(np.int64(1) << (join(wide, np.int64) - 6)))


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in turn."""
    return np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)


def _largest(size: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """The largest size of an other text for which enough pieces are left from ``place`` on in one of ``size``."""
    out = np.empty(len(size), np.int32)
    for k in range(0, len(size), STEP_WORDS):
        n, left = size[k : k + STEP_WORDS].astype(np.float64), place[k : k + STEP_WORDS]
        out[k : k + STEP_WORDS] = np.floor(np.minimum((n - left + (MEET - 1)) / share_of(threshold) - n, n / threshold) + 1e-6)
    return out


def folded(texts: Ordered, rows: np.ndarray, wide: int) -> np.ndarray:
    """Parity words of ``rows`` as if each had 2 ** ``wide`` bits; none has fewer."""
    n, each = np.diff(texts.word_at)[rows], 1 << (wide - 6)
    out = np.zeros((len(rows), each), np.uint64)
    for width in np.unique(n):
        on = np.nonzero(n == width)[0]
        held = texts.words[texts.word_at[rows[on]][:, None] + np.arange(width)]
        out[on] = np.bitwise_xor.reduce(held.reshape(len(on), -1, each), axis=1)
    return out


class Block:
    """Texts of one side: the entries of their prefixes in order of the ranks, each rank once, and where its entries begin."""

    def __init__(self, forms: list[str], levels: np.ndarray, threshold: float, width: int = 5) -> None:
        self.forms, self.threshold, self.width = forms, threshold, width
        # No text that is small enough for a size class of the other side has fewer bits than that class.
        self.texts = ordered(forms, levels, threshold, 1 + math.ceil(-math.log2(threshold)), width)
        keep = np.diff(self.texts.at)
        size = np.repeat(self.texts.sizes.astype(np.int32), keep)
        high = _largest(size, _counting(keep), threshold)
        order = np.argsort(self.texts.ranks).astype(np.int32)
        ranks = self.texts.ranks[order]
        self.texts = self.texts._replace(ranks=ranks[:0])
        new = _firsts(ranks)
        self.ranks, self.begin = ranks[new], np.append(new, len(ranks))
        del ranks, new
        # The text of each entry, its size, and the largest other text that the piece can be one of the first MEET common ones
        # with. Numbers of 16 bits are sorted much faster.
        self.size, self.high = size[order], high[order]
        del size, high
        self.text = np.repeat(np.arange(len(forms), dtype=np.uint16 if len(forms) <= 1 << 16 else np.int32), keep)[order]
        # Common prefix pieces that a pair of each text has at least: the other one has the share of the threshold of its pieces.
        self.need = np.minimum(MEET, np.ceil(share_of(threshold) * (1 + threshold) * self.texts.sizes - 1e-6)).astype(np.int64)


class Held(NamedTuple):
    """Texts of the other side that are in one size class, by the pieces of their prefixes.

    Entries stand in order of their ranks, those of a rank by the largest other text that the piece can be one of the
    first MEET common ones with: ``ranked`` has the rank's number above that size."""

    numbers: np.ndarray
    forms: list[str]
    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    begin: np.ndarray
    ranked: np.ndarray
    owner: np.ndarray

    def pairs(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text of the block, own number, share of common pieces) of all pairs that meet the block's threshold."""
        if not len(self.owner) or not len(block.size):
            return
        texts, threshold, own = block.texts, block.threshold, self.sizes.astype(np.int32)
        least, most = own.min(), int((self.ranked & 0xFFFFFFFF).max())
        found = []
        for r in range(0, len(block.ranks), STEP_WORDS):
            rank, begin = block.ranks[r : r + STEP_WORDS], block.begin[r : r + STEP_WORDS + 1]
            code = np.searchsorted(self.ranks, rank)
            code[self.ranks[np.minimum(code, len(self.ranks) - 1)] != rank] = -1
            code = np.repeat(code, np.diff(begin))
            lo, hi = begin[0], begin[-1]
            on = np.nonzero((code >= 0) & (block.high[lo:hi] >= least) & (block.size[lo:hi] <= most))[0]
            code, on = code[on], lo + on
            first = np.searchsorted(self.ranked, (code << 32) | block.size[on])
            count = self.begin[code + 1] - first
            some = np.nonzero(count)[0]
            on = on[some]
            found.append((block.text[on], block.high[on], first[some].astype(np.int32), count[some].astype(np.int32)))
        text, high, first, count = map(np.concatenate, zip(*found))
        del found
        order = np.argsort(text, kind="stable")
        text, high, first, count = text[order], high[order], first[order], count[order]
        del order
        # Steps end between texts, so that all matches of a pair are in one step.
        start = _firsts(text)
        total = np.add.reduceat(count, start, dtype=np.int64) if len(start) else start
        step = (np.cumsum(total) - 1) // STEP_MATCHES
        cuts = [*start[_firsts(step)], len(text)]
        wide = 6 + int(self.words.shape[1]).bit_length() - 1
        for lo, hi in zip(cuts, cuts[1:]):
            n, head = count[lo:hi], _firsts(text[lo:hi])
            rows = text[lo:hi][head].astype(np.int64)
            owner = self.owner[_ranges(first[lo:hi], n)]
            pair = np.repeat(np.repeat(np.arange(len(rows)) * len(own), np.diff(np.append(head, hi - lo))), n)
            pair += owner
            fits = own[owner] <= np.repeat(high[lo:hi], n)
            pair = _frequent(pair[fits], int(block.need[rows].min()))
            pair.sort()
            new = _firsts(pair)
            i, j = np.divmod(pair[new], len(own))
            i = rows[i]
            both = texts.sizes[i] + self.sizes[j]
            need = np.ceil(share_of(threshold) * both - 1e-6).astype(np.int64)
            many = np.nonzero(np.diff(np.append(new, len(pair))) >= np.minimum(MEET, need))[0]
            i, j, differ = i[many], j[many], (both - 2 * need)[many]
            used, at = np.unique(i, return_inverse=True)
            words, each = folded(texts, used, wide), max(1, STEP_WORDS // self.words.shape[1])
            near = np.concatenate([np.zeros(0, np.int64), *(k + np.nonzero(np.bitwise_count(words[at[k : k + each]] ^ self.words[j[k : k + each]]).sum(axis=1, dtype=np.int32) <= differ[k : k + each])[0] for k in range(0, len(i), each))])
            i, j = i[near], j[near]
            similar = similarity([block.forms[k] for k in i], [self.forms[k] for k in j], block.width)
            ok = similar >= threshold
            yield i[ok], self.numbers[j[ok]], similar[ok]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each value begins in sorted ``values``."""
    return np.nonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))[0]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first`` .. ``first + n - 1`` of each in turn."""
    out = np.repeat(first - (np.cumsum(n, dtype=np.int64) - n), n)
    out += np.arange(len(out))
    return out


def _frequent(values: np.ndarray, least: int) -> np.ndarray:
    """``values`` without most of those that occur fewer than ``least`` times; all others are kept.

    Counters are shared by several values, so a count is too high, never too low."""
    if least < 2 or not len(values):
        return values
    counter = values & ((1 << max(8, len(values).bit_length() - 1)) - 1)
    return values[(np.bincount(counter) >= least)[counter]]


def _held(numbers: np.ndarray, forms: list[str], sizes: np.ndarray, ranks: np.ndarray, keep: np.ndarray, words: np.ndarray, threshold: float) -> Held:
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), keep)
    most = _largest(sizes[owner], _counting(keep), threshold)
    order = np.lexsort((most, ranks))
    ranks = ranks[order]
    begin = np.append(_firsts(ranks), len(ranks))
    return Held(numbers, forms, sizes, words, ranks[begin[:-1]], begin, _numbered(begin, most[order]), owner[order])


def _numbered(begin: np.ndarray, most: np.ndarray) -> np.ndarray:
    out = np.repeat(np.arange(len(begin) - 1, dtype=np.int64) << 32, np.diff(begin))
    out |= most
    return out


def held_classes(numbers: np.ndarray, forms: list[str], sizes: np.ndarray, ranks: list[np.ndarray], words: list[np.ndarray], threshold: float) -> list[Held]:
    """``Held`` of each size class; ``ranks`` and ``words`` as of ``ordered`` with ``spare`` 1, one array a text."""
    kind = np.maximum(size_class(sizes) + 1, LEAST_WIDE)
    out = []
    for k in np.unique(kind):
        on = np.nonzero(kind == k)[0]
        keep = np.array([len(ranks[i]) for i in on], np.int64)
        out.append(_held(numbers[on], [forms[i] for i in on], sizes[on], np.concatenate([ranks[i] for i in on]), keep, np.stack([words[i] for i in on]), threshold))
    return out


def held_of(forms: list[str], levels: np.ndarray, threshold: float, width: int = 5) -> list[Held]:
    """``Held`` of each size class of ``forms``, by their places."""
    texts = ordered(forms, levels, threshold, 1, width)
    each = lambda x, at: [x[i:j] for i, j in zip(at, at[1:])]
    return held_classes(np.arange(len(forms)), forms, texts.sizes, each(texts.ranks, texts.at), each(texts.words, texts.word_at), threshold)


#: A size class as a row: texts by their places in the list of all, and arrays as of ``Held``, of ``ranked`` the sizes only.
PACKED = "numbers binary, words binary, ranks binary, begin binary, most binary, owner binary"


def packed(forms: list[str], levels: np.ndarray, threshold: float) -> Iterator[pd.DataFrame]:
    """A row for each size class of ``forms``."""
    for h in held_of(forms, levels, threshold):
        yield pd.DataFrame({"numbers": [h.numbers.tobytes()], "words": [h.words.tobytes()], "ranks": [h.ranks.tobytes()], "begin": [h.begin.tobytes()], "most": [h.ranked.astype(np.int32).tobytes()], "owner": [h.owner.tobytes()]})


def unpacked(rows: pd.DataFrame, numbers: np.ndarray, forms: list[str], sizes: np.ndarray) -> list[Held]:
    """``Held`` of each of ``rows``; the texts as ``packed`` had them."""
    out = []
    for r in rows.itertuples():
        on, begin = np.frombuffer(r.numbers, np.int64), np.frombuffer(r.begin, np.int64)
        words = np.frombuffer(r.words, np.uint64).reshape(len(on), -1)
        out.append(Held(numbers[on], [forms[i] for i in on], sizes[on], words, np.frombuffer(r.ranks, np.uint64), begin, _numbered(begin, np.frombuffer(r.most, np.int32)), np.frombuffer(r.owner, np.int32)))
    return out


def similarity(left: list[str], right: list[str], width: int = 5) -> np.ndarray:
    """Share of common pieces of each pair of texts."""
    out = np.zeros(len(left))
    for lo, hi in steps([x + y for x, y in zip(left, right)]):
        a, b, common = shared_counts(left[lo:hi], right[lo:hi], width)
        out[lo:hi] = common / np.maximum(a + b - common, 1)
    return out
