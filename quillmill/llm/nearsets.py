"""Problem 4: near-duplicate texts by token-combination prefixes.

A token is a five-character piece of the consistent form. The hash order of the tokens, read as a ring and entered
at ``ENTRIES`` fixed places, gives each text that many prefixes in orders shared by all texts. A prefix that starts
with a rare token is that token alone; while its tokens are frequent it is extended, so that its k-token
combination is expected in about ``EXPECTED`` texts by the token counts of all texts. The combinations are indexed;
texts that share one are candidates, and every candidate is verified exactly on its whole piece sets.

Two texts with a share J of common pieces agree on a prefix of k tokens with probability J**k at each place, so the
chance that a pair at the threshold shares none of the places is about (1 - J**k)**ENTRIES. Copies are folded into
one text beforehand and no bucket or partner list is capped: every bucket is paired whole. A bucket of more than
``WIDE`` texts is cut into blocks that are paired with each other in different tasks, and of its pairs only those whose
sizes and sketches allow the threshold (as for every candidate later on) become candidates.

Defined results: null and blank texts take part in no pair; a text shorter than a piece is one piece; rows repeated
under one id count once; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.shingles import pieces, steps
from quillmill.llm.pairs import GROUP_SLICE, within_groups
from quillmill.llm.textsets import SKETCH_WORDS, Texts, distinct_texts, plausible_pairs, ring, verified
from quillmill.plans.durable import cut

THRESHOLD = 0.6
#: Prefixes of a text, and the longest combination: a longer one would lose pairs at the threshold.
#: Four tokens meet with 0.6**4 at a place, so what 32 places miss stays about 1 % there, however many texts there are.
ENTRIES, LONGEST = 32, 4
#: Texts in which an indexed combination is expected at most.
EXPECTED = 0.5
#: Size from which a bucket's pairs are compared by size and sketch first, and texts of such a bucket that one block takes.
WIDE, BLOCK = 48, 8192
#: Counters of the token count sketch; a fixed size, so what is broadcast doesn't grow.
SKETCH_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 44) - 1)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, texts = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for b in batches:
        forms = list(b["form"])
        for lo, hi in steps(forms):
            keys, _ = pieces(forms[lo:hi])
            total += np.bincount((keys & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS)
            texts += hi - lo
    if texts:
        parts = total.reshape(16, -1)
        yield pd.DataFrame({"part": np.arange(16, dtype=np.int32), "counts": [p.tobytes() for p in parts], "texts": [texts] + [0] * 15})


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // 16, np.int64)
    for c in group["counts"]:
        total += np.frombuffer(c, np.int64)
    return pd.DataFrame({"part": group["part"].iloc[:1], "counts": [total.tobytes()], "texts": [int(group["texts"].sum())]})


def token_shares(forms: DataFrame) -> tuple[np.ndarray, int]:
    """The share of all texts that hold a token, by counter of the sketch, and the number of texts."""
    schema = "part int, counts binary, texts long"
    rows = forms.select("form").mapInPandas(_count, schema).groupBy("part").applyInPandas(_add, schema).collect()
    counts, texts = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for r in rows:
        counts.reshape(16, -1)[r["part"]] = np.frombuffer(r["counts"], np.int64)
        texts += r["texts"]
    return (counts / max(texts, 1)).clip(1e-12, 1.0).astype(np.float32), texts


def combinations(texts: list[str], shares: np.ndarray, total: int, entries: int = ENTRIES, longest: int = LONGEST, most: float = EXPECTED) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a step: (number of the text, combination)."""
    keys, at = pieces(texts)
    size = np.diff(at)
    rows = np.nonzero(size)[0]
    n, start = size[rows][:, None], at[:-1][rows][:, None]
    first = ring(keys, at, rows, entries)
    combo = np.zeros(first.shape, np.uint64)
    expected = np.full(first.shape, float(total))
    for k in range(longest):
        token = keys[start + (first + k) % n] & _LOW
        grow = (k < n) & (expected > most)
        share = shares[(token & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
        mixed = (token + np.uint64(k + 1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        combo = np.where(grow, (combo ^ mixed) * _MIX, combo)
        expected = np.where(grow, expected * share, expected)
    text = np.repeat(rows, entries).reshape(first.shape)
    order = np.lexsort((combo.ravel(), text.ravel()))
    t, c = text.ravel()[order], combo.ravel()[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]) if len(t) else np.zeros(0, bool)
    return t[new], c[new]


def _index(shares, total: int, *settings):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shares.value
        for b in batches:
            forms, docs = list(b["form"]), b["doc"].to_numpy()
            for lo, hi in steps(forms):
                t, c = combinations(forms[lo:hi], table, total, *settings)
                yield pd.DataFrame({"entry": (c >> np.uint64(16)).view(np.int64), "doc": docs[lo:hi][t]})

    return index


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys in a sorted array."""
    start = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return start, np.diff(np.concatenate([start, [len(keys)]]))


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b, 0) of docs in one bucket; of a wide bucket its members (bucket, doc, bucket's size)."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    entry = np.concatenate([b["entry"].to_numpy() for b in held])
    doc = np.concatenate([b["doc"].to_numpy() for b in held])
    del held
    order = np.argsort(entry)
    entry, doc = entry[order], doc[order]
    start, size = _runs(entry)
    wide = np.repeat(size > WIDE, size)
    if wide.any():
        yield pd.DataFrame({"a": entry[wide], "b": doc[wide], "crowd": np.repeat(size, size)[wide].astype(np.int32)})
    several = (size > 1) & (size <= WIDE)
    start, size = start[several], size[several]
    parts, waiting = [], 0
    for gap in range(1, int(size.max(initial=1))):
        on = size > gap
        start, size = start[on], size[on]
        many = np.repeat(start, size - gap) + _counting(size - gap)
        x, y = doc[many], doc[many + gap]
        parts.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y])
        waiting += len(parts[-1])
        if waiting > 500_000:
            yield _unique(parts)
            parts, waiting = [], 0
    if parts:
        yield _unique(parts)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _unique(parts: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate(parts), columns=["a", "b"]).drop_duplicates().assign(crowd=np.int32(0))


def _block(threshold: float):
    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        del held
        key, doc, size = np.unique(rows["block"], return_inverse=True)[1], rows["doc"].to_numpy(), rows["pieces"].to_numpy()
        words = [rows[f"s{k}"].to_numpy().view(np.uint64) for k in range(SKETCH_WORDS)]
        low, high = (np.nonzero(rows[side].to_numpy())[0] for side in ("low", "high"))
        same = rows["low"].to_numpy() & rows["high"].to_numpy()
        for i, j in plausible_pairs(*((key[x], size[x], [w[x] for w in words]) for x in (low, high)), threshold):
            a, b = doc[low[i]], doc[high[j]]
            ok = (a < b) | ((a != b) & ~same[low[i]])
            if ok.any():
                yield pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    return block


def _crowded(members: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the ``members`` (bucket, doc, size) of wide buckets whose sizes and sketches allow ``threshold``."""
    rows = members.join(forms.select("doc", "pieces", *[f"s{k}" for k in range(SKETCH_WORDS)]), "doc")
    slices = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), slices).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), slices - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(F.xxhash64("bucket", low, high).alias("block"), "doc", "pieces", *[f"s{k}" for k in range(SKETCH_WORDS)], (F.col("own") == low).alias("low"), (F.col("own") == high).alias("high"))
    return rows.repartition("block").mapInPandas(_block(threshold), "a long, b long")


def candidates(forms: DataFrame, threshold: float = THRESHOLD, entries: int = ENTRIES, longest: int = LONGEST, most: float = EXPECTED) -> DataFrame:
    """Distinct pairs (a, b) of docs that share an indexed combination; those of wide buckets as far as ``threshold`` allows."""
    shares, total = token_shares(forms)
    handed = forms.sparkSession.sparkContext.broadcast(shares)
    entries = forms.select("doc", "form").mapInPandas(_index(handed, total, entries, longest, most), "entry long, doc long")
    met = cut(entries.repartition("entry").mapInPandas(_meet, "a long, b long, crowd int"), "met")
    members = met.where("crowd > 0").select(F.col("a").alias("bucket"), F.col("b").alias("doc"), F.col("crowd").alias("size"))
    return met.where("crowd = 0").select("a", "b").unionByName(_crowded(members, forms, threshold)).distinct()


def links(forms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, similarity) of different docs with at least ``threshold`` of their pieces in common."""
    return verified(candidates(forms, threshold), forms, threshold)


def expand(found: DataFrame, texts: Texts) -> DataFrame:
    """Pairs of ids from pairs of docs, and of the ids that share a doc: (id_a, id_b).

    A doc of many ids is joined in slices, so a text that a third of the rows repeat fills no single task."""
    members = texts.members.select("id", "doc")
    sizes = members.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    slices = sizes.where(F.col("n") > GROUP_SLICE).select("doc", F.ceil(F.col("n") / GROUP_SLICE).cast("int").alias("slices"))
    sliced = lambda rows, key: rows.join(slices.withColumnRenamed("doc", key), key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    salted = sliced(members, "doc").select("id", "doc", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("salt"))

    def with_ids(rows: DataFrame, key: str, name: str) -> DataFrame:
        each = sliced(rows, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        return each.join(salted.withColumnsRenamed({"doc": key, "id": name}), [key, "salt"]).drop("salt")

    both = with_ids(with_ids(found.select("a", "b"), "a", "x"), "b", "y")
    pairs = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs.unionByName(within_groups(members.join(sizes, "doc"), ["doc"], "n").select("id_a", "id_b"))


def near_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``id_a < id_b`` of records whose consistent forms share ``threshold`` of their pieces, copies included."""
    texts = distinct_texts(records)
    return expand(links(texts.forms, threshold), texts)


def near_classes(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per record: (id, doc, group_id, links); copies share ``doc``, linked docs share ``group_id``."""
    texts = distinct_texts(records)
    found = cut(links(texts.forms, threshold), "links")
    members = texts.members.select("id", "doc")
    degree = found.select(F.col("a").alias("doc")).unionByName(found.select(F.col("b").alias("doc"))).groupBy("doc").agg(F.count("*").alias("links"))
    groups = connected(found)
    named = members.join(groups, "doc", "left").join(degree, "doc", "left")
    return named.select("id", "doc", F.coalesce("group_id", "doc").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def connected(found: DataFrame, rounds: int = 40) -> DataFrame:
    """(doc, group_id) of the linked docs: the smallest doc of each connected component.

    Alternates large-star and small-star steps; the edges of each round are a written table. Raises where ``rounds``
    steps don't suffice, rather than return groups that would still grow."""
    edges = found.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))).alias("s")).first()
        if state == (now["n"], now["s"]):
            break
        state = (now["n"], now["s"])
    else:
        raise RuntimeError(f"groups are still growing together after {rounds} rounds")
    own = edges.select(F.col("v").alias("doc"), F.col("v").alias("group_id"))
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("group_id")).unionByName(own).distinct()
