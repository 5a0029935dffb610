"""Byte n-gram language model: counts, interpolated scores, bits per byte.

Contexts of up to three bytes are whole numbers, so counting is one sort per batch in the workers followed by a sum
over partial counts. Held-out bytes are counted by context the same way; scoring joins distinct contexts with the
model instead of single positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.durable import cut

#: Weight ratio between orders, weight of the uniform distribution, and its bits per byte.
BASE, FLOOR, UNIFORM_BPB = 4.0, 0.1, 8.0
#: Longest context that fits the packed counts.
LONGEST = 6
STEP_BYTES = 2_000_000


def _contexts(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each k: (text, length of context, context, byte) of every position that has k bytes before it."""
    raw = [t.encode("utf-8") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    lens = np.array([len(r) for r in raw], np.int64)
    doc = np.repeat(np.arange(len(raw)), lens)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    context = np.zeros(len(data), np.int64)
    for k in range(order + 1):
        if k:
            context[k:] |= data[:-k] << (8 * (k - 1))
        on = place >= k
        yield doc[on], np.full(int(on.sum()), k), context[on] & ((1 << (8 * k)) - 1), data[on]


def _steps(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t.encode("utf-8"))
        if size >= STEP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for texts in _steps([t for t in b["text"] if t]):
                for _, k, context, byte in _contexts(texts, order):
                    packed, times = np.unique((context << 8) | byte, return_counts=True)
                    yield pd.DataFrame({"k": np.full(len(packed), k[0] if len(k) else 0, np.int32), "context": packed >> 8, "byte": (packed & 255).astype(np.int32), "n": times})

    return count


def ngram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(k, context, byte, n): how often each byte follows each context of k = 0 .. ``order`` bytes.

    A context never reaches over the start of its text; its first byte is its highest. Null and empty texts add
    nothing."""
    if not 0 <= order <= LONGEST:
        raise ValueError(f"order must be in 0 .. {LONGEST}")
    partial = rows.select("text").mapInPandas(_count(order), "k int, context long, byte int, n long")
    return partial.groupBy("k", "context", "byte").agg(F.sum("n").alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(k, context, total)."""
    return counts.groupBy("k", "context").agg(F.sum("n").alias("total"))


def _held(order: int):
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("language", dropna=False):
                for texts in _steps([t for t in part["text"] if t]):
                    parts = list(_contexts(texts, order))
                    for k, (_, _, context, byte) in enumerate(parts):
                        if k < order:
                            # Positions with exactly k bytes before them: those that have no longer context.
                            _, _, longer, _ = parts[k + 1]
                            firsts = len(context) - len(longer)
                            doc = parts[k][0]
                            start = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                            context, byte = context[start], byte[start]
                            assert len(context) == firsts
                        packed, times = np.unique((context << 8) | byte, return_counts=True)
                        yield pd.DataFrame({"language": pd.Series([lang if isinstance(lang, str) else None] * len(packed), dtype=object), "have": np.int32(k), "context": packed >> 8, "byte": (packed & 255).astype(np.int32), "n": times})

    return held


def bits_per_byte(model: DataFrame, rows: DataFrame, order: int) -> DataFrame:
    """(language, bytes, bits, total): bits of the held-out ``rows`` (language, text) under the model's counts.

    ``bits / bytes`` is the bits per byte; the row with ``total`` covers all languages. The probability of a byte
    interpolates the orders whose context was seen, each ``BASE`` times the weight of the next lower."""
    model = model.where(F.col("k") <= order)
    seen = rows.select("language", "text").mapInPandas(_held(order), "language string, have int, context long, byte int, n long")
    seen = seen.groupBy("language", "have", "context", "byte").agg(F.sum("n").alias("n"))
    places = seen.select("have", "context", "byte").distinct()
    masks = F.array(*[F.lit((1 << (8 * k)) - 1).cast("long") for k in range(order + 1)])
    suffix = F.col("context").bitwiseAND(F.element_at(masks, F.col("k") + 1))
    each = places.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("have")))).withColumn("part", suffix)
    totals = context_totals(model).withColumnRenamed("context", "part")
    counts = model.select("k", F.col("context").alias("part"), "byte", F.col("n").alias("c"))
    weight = F.pow(F.lit(BASE), F.col("k").cast("double"))
    scored = each.join(totals, ["k", "part"]).join(counts, ["k", "part", "byte"], "left").groupBy("have", "context", "byte").agg(
        F.sum(weight * F.coalesce("c", F.lit(0)) / F.col("total")).alias("up"), F.sum(weight).alias("down")
    )
    p = (F.lit(FLOOR / 256) + F.coalesce("up", F.lit(0.0))) / (F.lit(FLOOR) + F.coalesce("down", F.lit(0.0)))
    bits = seen.join(scored, ["have", "context", "byte"], "left").select("language", "n", (-F.log2(p) * F.col("n")).alias("b"))
    return bits.rollup("language").agg(F.sum("n").alias("bytes"), F.sum("b").alias("bits"), (F.grouping("language") == 1).alias("total"))


def next_byte_distribution(model: DataFrame, context: bytes, order: int) -> DataFrame:
    """(byte, p) for all 256 bytes after ``context``; the probabilities add up to 1."""
    spark = model.sparkSession
    tails = [(k, int.from_bytes(context[len(context) - k :], "big") if k else 0) for k in range(min(order, len(context)) + 1)]
    part = spark.createDataFrame(tails, "k int, context long")
    seen = model.join(F.broadcast(part), ["k", "context"])
    total = context_totals(seen)
    weight = F.pow(F.lit(BASE), F.col("k").cast("double"))
    up = seen.join(F.broadcast(total), ["k", "context"]).groupBy("byte").agg(F.sum(weight * F.col("n") / F.col("total")).alias("up"))
    down = total.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("down"))
    every = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    p = (F.lit(FLOOR / 256) + F.coalesce("up", F.lit(0.0))) / (F.lit(FLOOR) + F.col("down"))
    return every.join(F.broadcast(up), "byte", "left").crossJoin(F.broadcast(down)).select("byte", p.alias("p"))


def perplexity(bpb: Column) -> Column:
    """Perplexity per byte of bits per byte."""
    return F.pow(F.lit(2.0), bpb)


def evaluate_orders(split: DataFrame, orders: list[int]) -> DataFrame:
    """(order, language, bytes, bits, total) of models of each order, trained once at the highest and cut down.

    ``split``: (language, text, is_eval); held-out texts that stand in training are left out."""
    from quillmill.operators.splits import heldout_disjoint

    distinct = sorted(set(orders))
    # Every order reads both: training and held-out bytes are counted once.
    model = cut(ngram_counts(split.where(~F.col("is_eval")), distinct[-1]), "counts")
    held = cut(heldout_disjoint(split).select("language", "text"), "heldout")
    parts = [bits_per_byte(model, held, k).withColumn("order", F.lit(k)) for k in distinct]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("order", "language", "bytes", "bits", "total")


def best_order(results: DataFrame) -> DataFrame:
    """The order with the fewest bits per byte over all languages (rounded to four places); ties to the lowest."""
    bpb = F.round(F.when(F.col("bytes") > 0, F.col("bits") / F.col("bytes")).otherwise(0.0), 4)
    return results.where("total").select("order", bpb.alias("bits_per_byte"), F.round(perplexity(bpb), 2).alias("perplexity")).orderBy("bits_per_byte", "order").limit(1)
