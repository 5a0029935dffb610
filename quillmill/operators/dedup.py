"""Exact and near-duplicate removal that keeps the first.

The near rule is greedy: in order of position, a record is dropped when it is as similar as the threshold to one
already kept. That is the lexicographically first maximal independent set of the similarity graph, found here in
rounds of joins on edges only. The similarity join is exact: texts are written in shards in order of the sizes of their
n-gram sets, and each task joins a few neighbouring shards with themselves and all larger ones that the threshold allows
(``llm.prefixes``: prefixes of a global rare-first order, parity, verification on whole sets). N-grams are never rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.names import free
from quillmill.functions.shingles import pieces, shared_counts, steps
from quillmill.functions.text import content_hash
from quillmill.llm.prefixes import COUNTER_BITS, SAMPLE, Block, held_of, levels_of
from quillmill.plans.durable import cut, cut_parts, read_part

#: Characters of a shard at least and at most, and neighbouring shards that a task joins with others at once.
LEAST_CHARS, SHARD_CHARS, GROUP = 250_000, 4_000_000, 3


def exact_dedup(records: DataFrame) -> DataFrame:
    """The first record (by ``pos``) of each text; null texts are one text. Other columns are kept.

    Equal texts are found by SHA-1 of their bytes; the minimum position is aggregated map-side, so a text that
    makes up a third of the rows is no hot partition."""
    h = free(records, "_h")
    keyed = records.withColumn(h, F.coalesce(content_hash(F.col("text")), F.lit("")))
    first = keyed.groupBy(h).agg(F.min("pos").alias("pos"))
    return keyed.join(first, [h, "pos"], "left_semi").drop(h)


def _sized(n: int):
    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            sizes = [np.diff(pieces(texts[lo:hi], n)[1]) for lo, hi in steps(texts)]
            yield b.assign(pieces=np.concatenate([np.zeros(0, np.int64), *sizes]))

    return sized


class _Shard(NamedTuple):
    """Characters of a shard, and the smallest and largest n-gram set."""

    chars: int
    low: int
    high: int


def _shards(sizes: list[tuple[int, int, int, int]], most: int) -> tuple[list[_Shard], dict[int, tuple[int, int]]]:
    """Shards of ``most`` characters in order, and by step of size the first shard and the number of shards of its texts.

    ``sizes``: (step, characters, smallest, largest size) in order. A step that doesn't fit is spread over several."""
    shards: list[_Shard] = []
    place: dict[int, tuple[int, int]] = {}
    for step, chars, low, high in sizes:
        parts = -(-chars // most)
        if parts == 1 and shards and shards[-1].chars + chars <= most:
            shards[-1] = _Shard(shards[-1].chars + chars, shards[-1].low, high)
            place[step] = len(shards) - 1, 1
        else:
            place[step] = len(shards), parts
            shards += [_Shard(-(-chars // parts), low, high)] * parts
    return shards, place


def _joined(path: str, shards: list[_Shard], group: int, levels: Broadcast, threshold: float, n: int):
    def texts_of(number: int) -> tuple[np.ndarray, list[str]]:
        rows = read_part(path, "shard", number, ["pos", "text"]).sort_values("pos")
        return rows["pos"].to_numpy(np.int64), list(rows["text"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first in (int(k) for b in batches for k in b["first"]):
            own = range(first, min(first + group, len(shards)))
            parts = [texts_of(k) for k in own]
            begin = np.cumsum([0, *(len(t) for _, t in parts)])
            pos = np.concatenate([p for p, _ in parts])
            block = Block([t for _, texts in parts for t in texts], levels.value, threshold, n)
            low, high = min(shards[k].low for k in own), max(shards[k].high for k in own)
            del parts
            for number in range(first, len(shards)):
                if shards[number].low * threshold > high + 1e-6 or low * threshold > shards[number].high + 1e-6:
                    continue
                held_pos, texts = texts_of(number)
                for held in held_of(texts, levels.value, threshold, n):
                    for i, j, _ in held.pairs(block):
                        if number in own:
                            later = begin[number - first] + j > i
                            i, j = i[later], j[later]
                        yield _counted(pos[i], held_pos[j], [block.forms[k] for k in i], [texts[k] for k in j], n)
                del held_pos, texts

    return joined


def _counted(x: np.ndarray, y: np.ndarray, left: list[str], right: list[str], n: int) -> pd.DataFrame:
    common, total = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo, hi in steps([a + b for a, b in zip(left, right)]):
        a, b, common[lo:hi] = shared_counts(left[lo:hi], right[lo:hi], n)
        total[lo:hi] = a + b - common[lo:hi]
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "common": common, "total": total})


def similar_pairs(records: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(a, b, common, total): positions ``a < b`` of distinct texts whose n-gram sets have ``common / total`` at
    least ``threshold``; for texts that are exactly deduplicated and not null. ``threshold`` in (0, 1]."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = records.sparkSession
    texts = records.select(F.col("pos").cast("long").alias("pos"), "text").where("text <> ''")
    sized = texts.mapInPandas(_sized(n), "pos long, text string, pieces long")
    step = F.floor(16 * F.log2("pieces")).cast("int")
    sizes = sized.groupBy(step.alias("step")).agg(F.sum(F.length("text")).alias("chars"), F.min("pieces").alias("low"), F.max("pieces").alias("high"), F.count("*").alias("n")).orderBy("step").collect()
    # More shards than cores, so that small tables are joined by all of them.
    total, cores = sum(r["chars"] for r in sizes), spark.sparkContext.defaultParallelism
    most = min(SHARD_CHARS, max(LEAST_CHARS, total // (4 * GROUP * cores)))
    shards, place = _shards([(r["step"], r["chars"], r["low"], r["high"]) for r in sizes], most)
    if not shards:
        return spark.createDataFrame([], "a long, b long, common long, total long")
    of = F.create_map(*[F.lit(x) for k, (first, parts) in place.items() for x in (k, F.struct(F.lit(first).alias("first"), F.lit(parts).alias("n")))])[step]
    numbered = sized.select("pos", "text", of.alias("of")).select("pos", "text", (F.col("of.first") + F.pmod(F.xxhash64("pos"), F.col("of.n"))).cast("int").alias("shard"))
    path = cut_parts(numbered.repartition(min(len(shards), 4 * cores), "shard"), "shard", "shards")
    # The order of the n-grams decides the speed only; it comes from the counts of a sample.
    share = -(-sum(r["n"] for r in sizes) // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("pos"), F.lit(share)) == 0).select(F.col("text").alias("form")).repartition(1)
    counted = sample.mapInPandas(lambda batches: levels_of(batches, n), "levels binary").first()
    levels = spark.sparkContext.broadcast(np.frombuffer(counted["levels"], np.uint8) if counted else np.zeros(1 << COUNTER_BITS, np.uint8))
    group = GROUP if threshold >= 0.5 else 1
    tasks = -(-len(shards) // group)
    firsts = spark.range(0, tasks, 1, tasks).select((F.col("id") * group).cast("int").alias("first"))
    return firsts.mapInPandas(_joined(path, shards, group, levels, threshold, n), "a long, b long, common long, total long")


def dropped_positions(edges: DataFrame) -> DataFrame:
    """Positions dropped by the greedy rule on edges (a, b) with ``a < b``.

    Each round keeps every undecided record without an undecided or kept earlier neighbour and drops the later
    neighbours of kept ones; edges of decided records disappear. The edges of each round are a written table."""
    edges = cut(edges.select("a", "b").distinct(), "edges")
    dropped = None
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("a")).distinct()
        kept = edges.select("a").join(later, "a", "left_anti").distinct()
        gone = cut(edges.join(kept, "a", "left_semi").select(F.col("b").alias("pos")).distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = edges.join(gone.withColumnRenamed("pos", "a"), "a", "left_anti").join(gone.withColumnRenamed("pos", "b"), "b", "left_anti")
        edges = cut(rest, "edges")
    return dropped if dropped is not None else edges.select(F.col("a").alias("pos"))


def near_dedup(records: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Records kept by the greedy rule: equal texts first, then similar ones. ``threshold`` in [0, 1], ``n`` > 0.

    At threshold 0 only the first record stays. Texts without n-grams (empty ones) are equal to each other only."""
    if not 0 <= threshold <= 1 or n <= 0:
        raise ValueError("threshold must be in [0, 1] and n positive")
    unique = cut(exact_dedup(records), "unique")
    if threshold == 0:
        return unique.join(unique.agg(F.min("pos").alias("pos")), "pos", "left_semi")
    return unique.join(dropped_positions(similar_pairs(unique, threshold, n)), "pos", "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = free(rows, "_rank")
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) == 1).drop(rank)
