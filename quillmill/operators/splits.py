"""Held-out splits, byte budgets, and order of training."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.cleaners import paragraphs
from quillmill.functions.names import free
from quillmill.plans.durable import cut
from quillmill.sources.records import with_positions


def tail_split(rows: DataFrame, eval_frac: float = 0.12) -> DataFrame:
    """``rows`` with ``is_eval``: the last part, by id, of each language and source is held out.

    A group of one row stays in training. A missing source is its language; a missing id is empty; equal ids keep
    a stable but arbitrary order among themselves."""
    group = [F.col("language"), F.coalesce("source", "language")]
    place = F.row_number().over(Window.partitionBy("_lang", "_source").orderBy("_id", "_h", "_row"))
    size = F.count("*").over(Window.partitionBy("_lang", "_source"))
    last = F.greatest(F.lit(1), F.least(size - 1, F.floor(size * F.lit(1 - eval_frac)).cast("long")))
    # Only keys are ranked: no text passes through a window. The rows' numbers come from a written table.
    held = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "split")
    keys = held.select(group[0].alias("_lang"), group[1].alias("_source"), F.coalesce("id", F.lit("")).alias("_id"), F.xxhash64("text").alias("_h"), "_row")
    ranked = keys.select("_row", ((size >= 2) & (place > last)).alias("is_eval"))
    return held.join(ranked, "_row").drop("_row")


def heldout_disjoint(split: DataFrame) -> DataFrame:
    """Held-out rows whose text isn't in training; compared by hash, repeated rows are kept."""
    h = free(split, "_h")
    hashed = split.withColumn(h, F.sha1(F.encode("text", "UTF-8")))
    train = hashed.where(~F.col("is_eval")).select(h).distinct()
    return hashed.where("is_eval").join(train, h, "left_anti").drop(h)


def paragraph_rows(sources: DataFrame, fine: bool = False) -> DataFrame:
    """(id, key, idx, text, bytes): paragraphs of (key, text), numbered over all paragraphs of their source."""
    parts = sources.select("key", F.posexplode(paragraphs(F.col("text"), fine)).alias("idx", "text"))
    return parts.select(F.format_string("%s-%04d", "key", "idx").alias("id"), "key", F.col("idx").cast("long").alias("idx"), "text", F.octet_length("text").cast("long").alias("bytes"))


def byte_budget(parts: DataFrame, most: int, group: str = "language", source_order: str = "ord") -> DataFrame:
    """Paragraphs kept under a byte budget per group: (group, ord, key, idx, text, bytes).

    Sources are taken in order; a source ends at its first paragraph that would overflow, later ones go on with
    what is left, and all stop once the budget is full. A source's paragraphs are summed where they stand; only its
    running sums, up to the budget, pass one by one through a stream per group, and the kept ones are joined back."""
    running = F.sum("bytes").over(Window.partitionBy(group, source_order).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    sums = parts.select(group, source_order, "idx", "bytes").withColumn("upto", running).where(F.col("upto") <= most)
    sources = sums.groupBy(group, source_order).agg(F.array_sort(F.collect_set("upto")).alias("upto"))
    placed = sources.repartition(group).sortWithinPartitions(group, source_order)
    kinds = dict(parts.dtypes)
    room = placed.mapInPandas(_spend(most, group, source_order), f"`{group}` {kinds[group]}, `{source_order}` {kinds[source_order]}, room long")
    keep = sums.join(room, [group, source_order]).where("upto <= room").select(group, source_order, "idx")
    return parts.join(keep, [group, source_order, "idx"], "left_semi")


def _spend(most: int, group: str, order: str):
    """What is left for each source, or -1 once the budget is full."""

    def spend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = object(), 0
        for b in batches:
            room = []
            for g, upto in zip(b[group], b["upto"]):
                if g != current:
                    current, used = g, 0
                room.append(most - used if used < most else -1)
                used += int(upto[np.searchsorted(upto, room[-1], side="right") - 1]) if len(upto) and upto[0] <= room[-1] else 0
            yield b[[group, order]].assign(room=room)

    return spend


def load_order(rows: DataFrame, seed: int | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with ``ord``, their place in training: input order, or with a seed the order of a hash of seed and id.

    Deterministic, a permutation, and resumable: ``start`` drops the first rows of the order, ``limit`` ends it.
    Places are dense and come from a distributed sort."""
    if start < 0 or (limit is not None and limit < 0):
        raise ValueError("start and limit must be non-negative")
    key = free(rows, "_k")
    keyed = rows if seed is None else rows.withColumn(key, F.xxhash64(F.lit(seed), F.col("id")))
    numbered = with_positions(keyed.withColumnRenamed("pos", "_pos"), *(["_pos"] if seed is None else [key, "_pos"]))
    numbered = numbered.withColumnRenamed("pos", "ord").withColumnRenamed("_pos", "pos").select(*rows.columns, "ord")
    end = F.lit(True) if limit is None else F.col("ord") < start + limit
    return numbered.where((F.col("ord") >= start) & end)


def emitted(n: int, seed: int, capacity: int) -> Iterator[int]:
    """Places 0 .. n-1 as a bounded buffer with a seeded generator emits them; ``capacity`` numbers are held at once.

    A full buffer gives up a random slot for each newcomer; at the end the rest leaves in random order."""
    draw = random.Random(seed).randrange
    held = list(range(min(capacity, n)))
    for newcomer in range(len(held), n):
        slot = draw(capacity)
        yield held[slot]
        held[slot] = newcomer
    while held:
        slot = draw(len(held))
        held[slot], last = held[-1], held[slot]
        held.pop()
        yield last


def buffer_order(n: int, seed: int, capacity: int) -> list[int]:
    """All places that ``emitted`` gives, at once."""
    return list(emitted(n, seed, capacity))


def buffered_load_order(rows: DataFrame, seed: int | None, capacity: int, start: int = 0) -> DataFrame:
    """Rows with ``ord`` in the exact order of a bounded shuffle buffer over dense positions ``pos``.

    Only numbers pass through the sequential buffer, in one task; the rows are joined to their places."""
    if start < 0:
        raise ValueError("start must be non-negative")
    if seed is None or capacity <= 1:
        return rows.withColumn("ord", F.col("pos")).where(F.col("ord") >= start)
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in b["n"]:
                order, at = emitted(int(n), seed, capacity), 0
                while part := list(islice(order, 100_000)):
                    yield pd.DataFrame({"pos": part, "ord": range(at, at + len(part))})
                    at += len(part)

    count = rows.agg(F.count("*").alias("n"))
    return rows.join(count.mapInPandas(places, "pos long, ord long"), "pos").where(F.col("ord") >= start)
