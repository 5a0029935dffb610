"""Evaluation texts in a corpus: flag or remove documents equal or similar to one of them.

Similarity is Jaccard on whole n-gram sets; the decision is made on the score rounded to four places, so that flag
and reported score always agree. Benchmark sets up to ``MOST_GRAMS`` n-grams go to the workers as sorted arrays and
each batch of documents meets them in one vectorised pass. A larger set is written in shards, which each task joins with
its documents one after another: n-grams of documents are never rows, and no shuffle has them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.names import free
from quillmill.functions.shingles import HASH_MASK, pieces, steps
from quillmill.functions.text import normalize_text
from quillmill.plans.durable import cut_parts, read_part

#: Largest benchmark set, in n-grams, that is handed to every worker.
MOST_GRAMS = 20_000_000
#: n-grams of a shard of a larger set, and common n-grams of documents and benchmark texts that one step holds.
SHARD_GRAMS, STEP_COMMON = 4_000_000, 1_000_000
_SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("same", T.BooleanType())])


def benchmark_profiles(benchmarks: DataFrame) -> DataFrame:
    """Distinct normalised benchmark texts that aren't empty."""
    return benchmarks.select(normalize_text(F.col("text")).alias("text")).where("text <> ''").distinct()


class _Profiles:
    """n-grams of all benchmark texts, sorted, with the texts that hold each."""

    def __init__(self, texts: list[str], n: int) -> None:
        self.texts = frozenset(texts)
        self.sizes = np.zeros(len(texts), np.int64)
        grams, owners = [], []
        for lo, hi in steps(texts):
            keys, at = pieces(texts[lo:hi], n)
            self.sizes[lo:hi] = np.diff(at)
            grams.append(keys & HASH_MASK)
            owners.append(lo + np.repeat(np.arange(hi - lo), np.diff(at)))
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner = owner[order]
        self.gram, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(order))

    def best(self, texts: list[str], n: int) -> np.ndarray:
        """Highest Jaccard share of each text with any benchmark text."""
        out = np.zeros(len(texts))
        if not len(self.gram):
            return out
        keys, at = pieces(texts, n)
        size = np.diff(at)
        gram = keys & HASH_MASK
        spot = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        hit = self.gram[spot] == gram
        doc, spot = np.repeat(np.arange(len(texts)), size)[hit], spot[hit]
        many = self.first[spot + 1] - self.first[spot]
        # Steps end between texts; a text that is more than a step is counted in parts.
        begin = np.nonzero(np.concatenate([np.ones(min(1, len(doc)), bool), doc[1:] != doc[:-1]]))[0]
        step = (np.cumsum(np.add.reduceat(many, begin)) - 1) // STEP_COMMON if len(begin) else begin
        cuts = [*begin[np.nonzero(np.concatenate([np.ones(min(1, len(step)), bool), step[1:] != step[:-1]]))[0]], len(doc)]
        for lo, hi in zip(cuts, cuts[1:]):
            if many[lo:hi].sum() > STEP_COMMON:
                for d in np.unique(doc[lo:hi]):
                    self._one(d, spot[lo:hi][doc[lo:hi] == d], size, out)
                continue
            pair = np.repeat(doc[lo:hi], many[lo:hi]) * len(self.sizes) + self._owners(spot[lo:hi])
            pair, common = np.unique(pair, return_counts=True)
            d, bench = pair // len(self.sizes), pair % len(self.sizes)
            np.maximum.at(out, d, common / (size[d] + self.sizes[bench] - common))
        return out

    def _owners(self, spot: np.ndarray) -> np.ndarray:
        many = self.first[spot + 1] - self.first[spot]
        return self.owner[np.repeat(self.first[spot], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]

    def _one(self, doc: int, spot: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        common = np.zeros(len(self.sizes), np.int64)
        part = np.cumsum(self.first[spot + 1] - self.first[spot]) // STEP_COMMON
        for k in np.unique(part):
            common += np.bincount(self._owners(spot[part == k]), minlength=len(common))
        out[doc] = (common / np.maximum(size[doc] + self.sizes - common, 1)).max()


#: The shard that this worker built last, by path, number and n.
_BUILT: dict[tuple[str, int, int], _Profiles] = {}


def _sharded(path: str, shards: int, n: int):
    """Profiles of a written set one after another, the one that is still there first."""

    def profiles():
        for number in sorted(range(shards), key=lambda k: (path, k, n) not in _BUILT):
            if (path, number, n) not in _BUILT:
                _BUILT.clear()
                _BUILT[path, number, n] = _Profiles(list(read_part(path, "shard", number, ["text"])["text"]), n)
            yield _BUILT[path, number, n]

    return profiles


def _scorer(held, n: int):
    """A column function: highest share (rounded) and equality of a normalised text with the benchmark texts; ``held``
    gives their profiles."""

    def score(s: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in s]
        best, same = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for profiles in held():
            for lo, hi in steps(texts):
                best[lo:hi] = np.maximum(best[lo:hi], profiles.best(texts[lo:hi], n))
            same |= np.fromiter((t in profiles.texts for t in texts), bool, len(texts))
        return pd.DataFrame({"score": [1.0 if e else round(float(x), 4) for x, e in zip(best, same)], "same": same})

    return F.pandas_udf(score, _SCORED)


def flag_contaminated(records: DataFrame, benchmarks: DataFrame, key: str = "id", threshold: float = 0.8, n: int = 5, joined: bool | None = None) -> DataFrame:
    """``records`` with ``contaminated`` and ``contamination_score`` (rounded; 1.0 for an exact match).

    Without benchmark texts nothing is flagged and every score is 0. A null text counts as empty. ``joined`` forces (or
    forbids) the plan for large benchmark sets."""
    profiles = benchmark_profiles(benchmarks)
    grams = profiles.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if grams == 0:
        return records.withColumns({"contaminated": F.lit(False), "contamination_score": F.lit(0.0)})
    if joined is None:
        joined = grams > MOST_GRAMS
    if joined:
        shards = -(-grams // SHARD_GRAMS)
        numbered = profiles.select("text", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
        held = _sharded(cut_parts(numbered.repartition(shards, "shard"), "shard", "benchmark"), shards, n)
    else:
        handed = records.sparkSession.sparkContext.broadcast(_Profiles([r["text"] for r in profiles.orderBy("text").collect()], n))
        held = lambda: [handed.value]
    name = free(records, "_found")
    scored = records.withColumn(name, _scorer(held, n)(normalize_text(F.coalesce("text", F.lit("")))))
    flagged = F.col(f"{name}.same") | (F.col(f"{name}.score") >= threshold)
    return scored.withColumns({"contaminated": flagged, "contamination_score": F.col(f"{name}.score")}).drop(name)


def remove_contaminated(records: DataFrame, benchmarks: DataFrame, key: str = "id", threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Records that aren't flagged, with their scores."""
    return flag_contaminated(records, benchmarks, key, threshold, n).where(~F.col("contaminated"))
