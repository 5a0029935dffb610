"""Problem 7: documents packed into containers of fixed capacity by best-two-fit.

A document larger than the capacity is cut into full containers and a rest; the rest and all other documents are
packed whole. Documents are spread over shards of about ``SHARD_ROWS`` by a hash of their id, so no task holds more
than a shard and a hot source changes nothing. In a shard a container is filled greedily with the largest document
that fits; then its smallest document is replaced by two unpacked documents that fill the widened gap more tightly.
Free sizes are a bit set, so the best pair is found by shifted intersections.

Defined results: a document without tokens (null or empty text) goes into the first container of its shard (a
container of its own if the shard has none) and fills nothing; every document appears once per window, cut ones
once per piece; ties take the smaller id first, so the arrangement is the same in every run.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.bpe import BpeModel
from quillmill.llm.tokens import token_counts
from quillmill.plans.durable import cut

#: Documents of a shard; a container never mixes shards, so each shard wastes at most its last containers.
SHARD_ROWS = 25_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes`` (all between 1 and ``capacity``)."""
    waiting: dict[int, list[int]] = {}
    for i in reversed(range(len(sizes))):
        waiting.setdefault(sizes[i], []).append(i)
    free = mirrored = 0
    for s in waiting:
        free |= 1 << s
        mirrored |= 1 << (capacity - s)

    def take(size: int) -> int:
        nonlocal free, mirrored
        i = waiting[size].pop()
        if not waiting[size]:
            free &= ~(1 << size)
            mirrored &= ~(1 << (capacity - size))
        return i

    def pair(least: int, most: int) -> tuple[int, int] | None:
        """Two waiting sizes whose sum is as large as possible in ``least`` .. ``most``."""
        for total in range(most, least - 1, -1):
            both = free & (mirrored >> (capacity - total))
            if total % 2 == 0 and both >> (total // 2) & 1 and len(waiting[total // 2]) < 2:
                both &= ~(1 << (total // 2))
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None

    out = []
    while free:
        held, gap = [], capacity
        while fitting := free & ((1 << (gap + 1)) - 1):
            size = fitting.bit_length() - 1
            held.append((size, take(size)))
            gap -= size
        if gap and free and held:
            smallest = held[-1][0]
            two = pair(smallest + 1, smallest + gap)
            if two:
                size, back = held.pop()
                if not waiting[size]:
                    free |= 1 << size
                    mirrored |= 1 << (capacity - size)
                waiting[size].append(back)
                held += [(s, take(s)) for s in two]
        out.append([i for _, i in held])
    return out


PACKED = "window_name string, container_id string, doc_id long, piece int, first_token long, n_tokens long"


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece"], ignore_index=True)
    capacity = int(group["capacity"].iloc[0])
    filled = group.index[group["n_tokens"] > 0]
    sizes = [int(x) for x in group["n_tokens"].iloc[filled]]
    place = pd.Series("0", index=group.index, dtype=object)
    for k, positions in enumerate(best_two_fit(sizes, capacity)):
        place.iloc[filled[positions]] = str(k)
    group["container_id"] = group["shard"].astype(str) + "-" + place
    return group[["window_name", "container_id", "doc_id", "piece", "first_token", "n_tokens"]]


def pack(sized: DataFrame, windows: DataFrame) -> DataFrame:
    """The container of every document: ``sized`` has (doc_id, tokens), ``windows`` (window_name, capacity_tokens)."""
    sized = cut(sized.select("doc_id", "tokens"), "sized")
    shards = max(1, -(-sized.count() // SHARD_ROWS))
    valid = [(r["window_name"], int(r["capacity_tokens"])) for r in windows.where("capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().collect()]
    # Few windows by definition: each becomes a literal of the plan, not a joined side.
    wide = sized.withColumn("window", F.explode(F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(valid)])))
    each = wide.select("doc_id", "tokens", "window.*", F.floor(F.col("tokens") / F.col("capacity")).cast("long").alias("full"))
    cut_pieces = each.where("tokens > capacity").select("window_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = cut_pieces.select(
        "window_name", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container_id"), "doc_id",
        F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"),
    )
    over = F.col("tokens") > F.col("capacity")
    rest = each.select(
        "window_name", "capacity", "doc_id", F.when(over, F.col("full")).otherwise(0).cast("int").alias("piece"),
        F.when(over, F.col("full") * F.col("capacity")).otherwise(0).cast("long").alias("first_token"),
        F.when(over, F.col("tokens") - F.col("full") * F.col("capacity")).otherwise(F.col("tokens")).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    ).where("piece = 0 or n_tokens > 0")
    packed = rest.groupBy("window_name", "shard").applyInPandas(_pack, PACKED)
    return packed.unionByName(whole)


def pack_documents(documents: DataFrame, windows: DataFrame, model: BpeModel) -> DataFrame:
    """Containers of ``documents`` (doc_id, text), sized in tokens of ``model``, for every window."""
    return pack(token_counts(documents.where("doc_id is not null"), "doc_id", model), windows)


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, documents, tokens, and unused tokens."""
    used = packed.groupBy("window_name").agg(F.countDistinct("container_id").alias("containers"), F.countDistinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"))
    capacity = windows.where("capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    return used.join(capacity, "window_name").select("window_name", "capacity", "containers", "documents", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused_tokens"))


