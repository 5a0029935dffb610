"""Problem 9: pages made of repeated keywords, links or product tags.

Each page gets a suffix automaton over its units (words, or single signs in Chinese
and Japanese script), case-folded. A unit is covered where the longest suffix that ends in it and occurs often
enough in the page (a repeated maximal substring) reaches over it. Added to that are characters of links and of
product tags. Full sentences whose units are not such repetitions count as clauses. A page is a case where
more than half of it lies outside clauses and that part is densely covered (lists of tags also hold some unique
ones; ordinary lists and tables are covered by less than a fifth). Code is no case: pages whose lines are
mostly statements, assignments or calls are left out.

The automaton is linear in the page, and every page gets one.

Defined results: null and blank texts are no cases; a text is judged whole whatever its length
(in blocks of ``AT_ONCE`` units); rows are judged one
by one, so repeated texts give the same verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.sentences import ALL_GRAMMAR, LINK, is_code, spans
from quillmill.llm.visual import forms_of

#: Occurrences that make a substring a repetition: ``LEAST_TIMES`` from ``LONG`` units on; a shorter one needs this
#: share of the page's units too, but never more than ``ENOUGH_TIMES``.
LEAST_TIMES, LEAST_SHARE, ENOUGH_TIMES, LONG = 3, 0.012, 12, 4
#: Product tags from which they count as such.
LEAST_TAGS = 8
#: Units that one automaton takes; in a longer page, substrings of up to ``LONG`` units are counted over all blocks.
AT_ONCE = 100_000
#: A page is a case where more than this share of it is outside clauses, and at least this share of that is covered.
MOSTLY, DENSITY = 0.5, 0.25

_UNIT = re.compile(r"[一-鿿々]|[ぁ-ゖ]+|[ァ-ヺー]+|[^\W\d_]+|\d+")
_CODE_TAG = re.compile(r"(?:SKU|No\.|ref-|art\.|item|id)[ -]?\d+", re.I)
_TAGGED = re.compile(r"(?:^|(?<=[|/\n,;•·»]))[^|/\n,;•·»]{1,60}?\s(?:(?:SKU|No\.|ref-|art\.)[ -]?\d+|\(\d+\))(?=\s*(?:$|[|/\n,;•·»]))", re.M)
_HOST_END = re.compile(r"\.(?:test|example|invalid|com|net|org|info|html)\b")
_TAG_MARK = re.compile(r"(?:SKU|No\.|ref-|art\.)[ -]?\d|\(\d+\)")
_HASH = re.compile(r"(?<!\S)#[^\s#]+")


class SuffixAutomaton:
    """Suffix automaton of runs of hashable units (``None`` ends a run), with occurrence counts."""

    def __init__(self, units: list) -> None:
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for u in units:
            if u is None:
                last = 0
                continue
            there = nxt[last].get(u)
            if there is not None:
                # Only behind the end of a run: the string is known already.
                last = there if length[there] == length[last] + 1 else self._clone(last, u, there)
                count[last] += 1
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            count.append(1)
            link.append(0)
            p = last
            while p >= 0 and u not in nxt[p]:
                nxt[p][u] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][u]
                link[cur] = q if length[p] + 1 == length[q] else self._clone(p, u, q)
            last = cur
        self.order = np.argsort(np.array(length), kind="stable").tolist()
        for s in reversed(self.order):
            if link[s] >= 0:
                count[link[s]] += count[s]

    def _clone(self, p: int, u: object, q: int) -> int:
        """A state of its own for the shorter strings of ``q`` that end with ``u`` behind ``p``."""
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(u) == q:
            self.next[p][u] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def repeated_suffixes(self, units: list, times: int, long: int | None = None) -> list[int]:
        """For each position, the length of the longest suffix of its run ending there that occurs ``times`` or more.

        From ``LONG`` units on, ``long`` occurrences (``times`` by default) are enough."""
        long = times if long is None else long
        link, length, count = self.link, self.length, self.count
        best = [0] * len(length)
        for s in self.order[1:]:
            best[s] = length[s] if count[s] >= (long if length[s] >= LONG else times) else best[link[s]]
        out, state = [], 0
        for u in units:
            state = 0 if u is None else self.next[state][u]
            out.append(best[state])
        return out


def _fill(mask: np.ndarray, found: Iterable[re.Match]) -> None:
    for m in found:
        mask[m.start() : m.end()] = True


def _counted(units: list, times: int) -> np.ndarray:
    """For each position, the units (``LONG`` at most) of the longest repetition of the whole page that ends there."""
    far = np.zeros(len(units), np.int64)
    for n in range(1, LONG + 1):
        grams = list(zip(*(units[k:] for k in range(n))))
        seen, least = Counter(grams), LEAST_TIMES if n == LONG else times
        far[n - 1 :][[seen[g] >= least for g in grams]] = n
    return far


def coverage(text: str) -> tuple[float, float, float, float]:
    """Shares of the non-blank characters of a page (in its consistent form): stuffed, repeated, links and tags, clauses."""
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 32) | (points == 10)
    size = max(n - int(np.count_nonzero(blank)), 1)
    low = text.lower()
    at = [m.span() for m in _UNIT.finditer(text)]
    units = [low[a:b] for a, b in at] if len(low) == n else [text[a:b].lower() for a, b in at]
    repeated = _repeated(n, at, units)
    links = np.zeros(n, bool)
    # What every link, hashtag or product tag holds is looked for first.
    if "<a" in text or "](" in text or "://" in text or "www." in text or _HOST_END.search(text):
        _fill(links, LINK.finditer(text))
    if "#" in text:
        _fill(links, _HASH.finditer(text))
    if len(_TAG_MARK.findall(text)) >= LEAST_TAGS:
        tagged = list(_TAGGED.finditer(text))
        if len(tagged) >= LEAST_TAGS:
            _fill(links, tagged)
    clause = np.zeros(n, bool)
    upto = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (repeated, links)]
    for a, b, _ in spans(text):
        if upto[0][b] - upto[0][a] < 0.45 * (b - a) and upto[1][b] - upto[1][a] < 0.3 * (b - a):
            clause[a:b] = True
    share = lambda x: np.count_nonzero(x & ~blank) / size
    return share((repeated | links) & ~clause), share(repeated), share(links), share(clause)


def _repeated(n: int, at: list[tuple[int, int]], units: list[str]) -> np.ndarray:
    """Mask of the characters under repeated maximal substrings."""
    seen = Counter(units)
    times = min(max(LEAST_TIMES, int(LEAST_SHARE * len(units)) + 1), ENOUGH_TIMES)
    # A unit that occurs less often than any repetition is in none: it only ends a run.
    runs = [u if seen[u] >= LEAST_TIMES else None for u in units]
    mask = np.zeros(n + 1, np.int32)
    whole = _counted(units, times) if len(units) > AT_ONCE else None
    # Characters of grammar words and numbers don't make a repetition; a sign of Chinese script says more than a letter.
    weight = {u: 0 if u is None or u in ALL_GRAMMAR or u.isdigit() else len(u) for u in set(runs)}
    own = np.concatenate([[0], np.cumsum([weight[u] for u in runs])])
    for block in range(0, len(units), AT_ONCE):
        held = runs[block : block + AT_ONCE]
        far = np.array(SuffixAutomaton(held).repeated_suffixes(held, times, LEAST_TIMES), np.int64)
        if whole is not None:
            far = np.maximum(far, whole[block : block + AT_ONCE])
        last = np.nonzero(far)[0] + block
        first = last - far[last - block] + 1
        heavy = own[last + 1] - own[first]
        for f, e, w in zip(first.tolist(), last.tolist(), heavy.tolist()):
            if w >= 4 or (w >= 2 and ("一" <= units[f] <= "鿿" or "一" <= units[e] <= "鿿")):
                mask[at[f][0]] += 1
                mask[at[e][1]] -= 1
    return np.cumsum(mask[:n]) > 0


def is_stuffed(text: str) -> bool:
    """Whether more than half of the page is repeated keywords, links or product tags."""
    if not text:
        return False
    stuffed, _, _, clauses = coverage(text)
    return 1 - clauses > MOSTLY and stuffed >= DENSITY * (1 - clauses) and not is_code(text)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b[b["text"].notna()]
        b = b.iloc[[is_stuffed(t) for t in forms_of(b["text"])] if len(b) else []]
        yield b[["doc_id"]]


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """Ids (``doc_id``) of the pages that are mostly repeated keywords, links or product tags."""
    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(_judge, "doc_id long")
