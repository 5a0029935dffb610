"""Problem 8: evaluation items that stand, whole or in part, inside training documents.

Documents become sequences of units (case-folded words of the consistent form; single signs in Japanese). Each
shard of documents gets an FM-index over the units that occur in some item, runs of other units being one symbol.
The items' phrases (``PHRASE`` units, in Japanese ``SIGNS``) are searched backward through wavelet ranks and located
by sampled suffix positions. The hits of an item in a document are merged into spans along their diagonal. A span
is a case when the best chain of matching runs in order covers at least half of the item's units, and enough of those
that the item does not share with ``SHARED`` or more items (instructions, closing questions; counted over all items).
From the first to the last unit of the chain is what would have to be removed; overlapping removals are merged.

The items are written as a table in blocks of ``BLOCK``; the tasks read it by reference, so no number of items is
refused, none pass through the driver, and the documents are read once for all blocks. Documents are never broadcast
or collected.

Defined results: null or blank documents and items give no pair; a pair is given once however often the item
occurs; texts of any length are searched whole; no items or no documents give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.fmindex import FMIndex
from quillmill.functions.shingles import steps
from quillmill.llm.visual import forms_of
from quillmill.plans.durable import cut, cut_parts, read_part

#: Units of a searched phrase: words, and signs where the text is Japanese.
PHRASE, SIGNS = 3, 6
#: Items that share a phrase from which it counts as an instruction or closing question.
SHARED = 4
#: Share of the item's units, and of its own units, that must be found; shortest run of units that counts.
HALF, OWN = 0.5, 0.4
#: Items searched together (a block is read whole by a task), characters of a shard.
BLOCK, SHARD_CHARS = 20_000, 1_500_000

_UNIT = re.compile(r"[一-鿿々ぁ-ゖァ-ヺー]|[^\W_一-鿿々ぁ-ゖァ-ヺー]+")


def units(form: str) -> list[str]:
    """Units of a text in its consistent form."""
    return _UNIT.findall(form.casefold())


def width_of(words: list[str]) -> tuple[int, bool]:
    """Units of an item's phrases, and whether it is mostly in signs."""
    signs = sum(len(w) == 1 and w >= "ぁ" for w in words) > 0.5 * len(words)
    return min(SIGNS if signs else PHRASE, len(words)), signs


class Items:
    """A block of items as sequences of symbol numbers, their phrases, and which units are the item's own.

    Rows are (id, words, starts of phrases that ``SHARED`` items or more have)."""

    def __init__(self, rows: list[tuple[str, list[str], list[int]]]) -> None:
        self.ids, self.words = [i for i, _, _ in rows], [w for _, w, _ in rows]
        self.number = {w: k + 2 for k, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.symbols = len(self.number) + 2
        self.coded = [np.array([self.number[w] for w in words]) for words in self.words]
        kinds = [width_of(words) for words in self.words]
        self.width, self.signs = [w for w, _ in kinds], [s for _, s in kinds]
        self.own, spots = [], []
        for n, (c, w) in enumerate(zip(self.coded, self.width)):
            own = np.ones(len(c), bool)
            for k in rows[n][2]:
                own[k : k + w] = False
            if not own.any():
                own[:] = True
            self.own.append(own)
            spots += [(n, k, w) for k in range(len(c) - w + 1) if own[k : k + w].any() or w == len(c)]
        self.spots = np.array(spots, np.int64).reshape(-1, 3)
        longest = int(self.spots[:, 2].max(initial=1))
        phrases = np.zeros((len(spots), longest), np.int64)
        for r, (n, k, w) in enumerate(spots):
            phrases[r, :w] = self.coded[n][k : k + w]
        self.phrases, self.which = np.unique(phrases, axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        self.by_phrase = np.argsort(self.which, kind="stable")
        self.phrase_at = np.searchsorted(self.which[self.by_phrase], np.arange(len(self.phrases) + 1))


def _repeat_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def found_in(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(number of the text, number of the item, first and last unit) of the items that stand in a shard of texts
    (consistent forms): every place where an item stands."""
    number = items.number
    coded = [np.fromiter((number.get(w, 1) for w in units(t)), np.int64) for t in texts]
    lens = np.array([len(c) + 1 for c in coded], np.int64)
    stream = np.ones(int(lens.sum()), np.int64)
    at = np.concatenate([[0], np.cumsum(lens)])
    for c, a in zip(coded, at):
        stream[a : a + len(c)] = c
    known = stream > 1
    keep = known.copy()
    keep[:-1] |= known[1:]
    place = np.nonzero(keep)[0]
    if not known.any() or not len(items.phrases):
        return []
    index = FMIndex(stream[place], items.symbols)
    lo, hi = index.search(items.phrases, items.lengths)
    size = np.maximum(hi - lo, 0)
    rows = _repeat_ranges(lo, size)
    phrase = np.repeat(np.arange(len(size)), size)
    where = place[index.locate(rows)]
    spots = items.phrase_at[phrase + 1] - items.phrase_at[phrase]
    spot = items.by_phrase[_repeat_ranges(items.phrase_at[phrase], spots)]
    where = np.repeat(where, spots)
    item, offset, width = items.spots[spot].T
    doc = np.searchsorted(at, where, side="right") - 1
    diagonal = where - offset
    order = np.lexsort((diagonal, item, doc))
    doc, item, where, offset, width, diagonal = (x[order] for x in (doc, item, where, offset, width, diagonal))
    out = []
    if not len(doc):
        return out
    size = np.array([len(c) for c in items.coded])
    slack = np.maximum(4, size[item] // 4)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])])
    group = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    cover = np.bincount(group, np.minimum(width, 2))
    # Every covered unit adds at most one hit, and each hit at least one unit: too few hits can't reach the share.
    hopeful = np.nonzero(cover >= np.maximum(2, HALF * 0.25 * size[item[starts]]))[0]
    ends = np.append(starts[1:], len(doc))
    for g in hopeful:
        s, e = starts[g], ends[g]
        d, i = int(doc[s]), int(item[s])
        # A chain of hits may drift along the text: what counts must stand in one place.
        reach = max(int(size[i]) // 2, int(slack[s]))
        at_once = s
        while at_once < e:
            upto = at_once + int(np.searchsorted(diagonal[at_once:e], diagonal[at_once] + reach, side="right"))
            place = _held_at(coded[d], int(where[at_once:upto].min() - at[d]), int(where[at_once:upto].max() - at[d]), items, i)
            if place:
                out.append((d, i, *place))
            at_once = upto
    return out


def runs(left: list[int], right: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in ``left``, start in ``right``, length) of the maximal equal runs of ``least`` units or more."""
    places: dict[tuple, list[int]] = {}
    for j in range(len(right) - least + 1):
        places.setdefault(tuple(right[j : j + least]), []).append(j)
    open_runs: dict[int, list[int]] = {}
    out = []
    for i in range(len(left) - least + 1):
        going = {}
        for j in places.get(tuple(left[i : i + least]), ()):
            run = open_runs.pop(i - j, None) or [i, j, least - 1]
            run[2] += 1
            going[i - j] = run
        out += open_runs.values()
        open_runs = going
    return [tuple(r) for r in [*out, *open_runs.values()]]


def chained(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs of the heaviest chain that goes forward in both sequences without overlap."""
    size = max((j + n for _, j, n in found), default=0) + 1
    # Best chain (weight, runs) by its end in the right sequence, as a tree of prefix maxima.
    tree: list[tuple[int, tuple | None]] = [(0, None)] * (size + 1)
    ending: list[tuple[int, int, int, tuple]] = []
    best: tuple[int, tuple | None] = (0, None)
    for i, j, n in sorted(found):
        while ending and ending[0][0] <= i:
            _, end, weight, chain = heappop(ending)
            while end <= size:
                if tree[end][0] < weight:
                    tree[end] = (weight, chain)
                end += end & -end
        before, at = (0, None), j
        while at > 0:
            before, at = max(before, tree[at], key=itemgetter(0)), at - (at & -at)
        chain = ((i, j, n), before[1])
        best = max(best, (before[0] + n, chain), key=itemgetter(0))
        heappush(ending, (i + n, j + n, before[0] + n, chain))
    out, chain = [], best[1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def _held_at(text: np.ndarray, first: int, last: int, items: Items, i: int) -> tuple[int, int] | None:
    """First and last unit of the matching runs around a span of a text, if they cover enough of an item."""
    item, own = items.coded[i], items.own[i]
    n = len(item)
    start = max(0, first - n)
    chain = chained(runs(item.tolist(), text[start : last + n + 1].tolist(), min(3 if items.signs[i] else 2, n)))
    got = np.zeros(n, bool)
    for a, _, size in chain:
        got[a : a + size] = True
    if got.sum() < HALF * n or got[own].sum() < OWN * own.sum():
        return None
    return start + chain[0][1], start + chain[-1][1] + chain[-1][2] - 1


def _phrased(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, words, phrase, start): every phrase of every item."""
    for b in batches:
        rows = []
        for i, form in zip(b["id"], forms_of(b["text"])):
            words = units(form)
            width = width_of(words)[0]
            rows += [(i, words if k == 0 else [], "\t".join(words[k : k + width]), k) for k in range(len(words) - width + 1) if words]
        yield pd.DataFrame(rows, columns=["id", "words", "phrase", "start"])


def item_table(items: DataFrame) -> tuple[str, int]:
    """The items as a written table in blocks: its path and the number of blocks."""
    there = items.select("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull()).groupBy("id").agg(F.min("text").alias("text"))
    blocks = max(1, -(-there.count() // BLOCK))
    phrases = cut(there.mapInPandas(_phrased, "id string, words array<string>, phrase string, start int"), "phrases")
    shared = phrases.select("phrase", "id").distinct().groupBy("phrase").agg(F.count("*").alias("items")).where(F.col("items") >= SHARED).select("phrase", F.lit(True).alias("shared"))
    marked = phrases.join(shared, "phrase", "left")
    rows = marked.groupBy("id").agg(F.max(F.when(F.col("start") == 0, F.col("words"))).alias("words"), F.array_sort(F.collect_list(F.when(F.col("shared"), F.col("start")))).alias("shared"))
    return cut_parts(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "block", "items"), blocks


#: The block of items that this worker read last.
_READ: dict[tuple[str, int], Items] = {}


def _block(path: str, number: int) -> Items:
    if (path, number) not in _READ:
        _READ.clear()
        rows = read_part(path, "block", number, ["id", "words", "shared"]).sort_values("id")
        _READ[path, number] = Items([(i, list(w), list(s)) for i, w, s in zip(rows["id"], rows["words"], rows["shared"])])
    return _READ[path, number]


def _search(path: str, blocks: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms = list(forms_of(b["text"]))
            docs = b["doc_id"].to_numpy()
            for lo, hi in steps(forms, SHARD_CHARS):
                for number in sorted(range(blocks), key=lambda k: (path, k) not in _READ):
                    items = _block(path, number)
                    rows = []
                    for d, i, first, last in found_in(forms[lo:hi], items):
                        places = [m.span() for m in _UNIT.finditer(forms[lo + d].casefold())]
                        rows.append((docs[lo + d], items.ids[i], places[first][0], places[last][1]))
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first", "last"]).astype({"doc_id": "int64", "item_id": str, "first": "int64", "last": "int64"})

    return search


def leaked_places(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last): each place of an item in a document, in characters of its case-folded form."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    return texts.mapInPandas(_search(*item_table(items)), "doc_id long, item_id string, first long, last long")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) of documents and the items they hold."""
    return leaked_places(documents, items).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, first, last, items): what to remove from each document; places that overlap or touch are one span."""
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = leaked_places(documents, items).withColumn("new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
    return numbered.groupBy("doc_id", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")
