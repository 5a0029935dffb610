"""Problem 6: exact token budget per source, language and domain.

Texts are counted under the project's byte-level BPE, which never splits a text beforehand. A text of more than
``LARGE`` bytes is cut only between two adjacent bytes that no token of the vocabulary holds inside: no merge can
reach across such a place, so the pieces' counts add up exactly. Pieces of large texts are spread over the workers
by a salt and summed per row; where no such place exists a piece simply grows. Rows are counted where they are read,
and only counts are shuffled.

Defined results: a null or blank text counts as 0 tokens (a blank text's blanks are tokens of its own and count);
an id delivered twice counts once; spellings of one label (letter case, blanks, ``-`` or ``_``) count together;
a missing label is looked up in the sources' table and else stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.bpe import BpeModel

#: Bytes from which a text is cut, and the bytes from which a piece ends at the next proven boundary.
LARGE, PIECE_BYTES = 1 << 20, 1 << 16
#: Most merges that a model may have to be handed to every worker.
MOST_MERGES = 1 << 20
#: Characters that the encoder takes at once.
ENCODE_CHARS = 400_000


def model_of(merges: DataFrame) -> BpeModel:
    """The model of a table (merge_rank, left_id, right_id, new_id); its size is checked before it is collected."""
    n = merges.count()
    if n > MOST_MERGES:
        raise ValueError(f"{n} merges are more than {MOST_MERGES}")
    return BpeModel([(r["left_id"], r["right_id"]) for r in merges.orderBy("merge_rank").collect()])


def independent_pieces(text: str, joined: set[bytes], size: int = PIECE_BYTES) -> list[str]:
    """Cut ``text`` into pieces of at least ``size`` bytes between bytes that no token holds side by side."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    table = np.zeros(1 << 16, bool)
    table[[p[0] << 8 | p[1] for p in joined]] = True
    free = np.nonzero(~table[(data[:-1].astype(np.int64) << 8) | data[1:]] & ((data[1:] & 0xC0) != 0x80))[0] + 1
    cuts, at = [0], 0
    while True:
        k = np.searchsorted(free, at + size)
        if k >= len(free):
            break
        at = int(free[k])
        cuts.append(at)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(cuts, [*cuts[1:], len(raw)])]


def _cut(handed):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joined = handed.value.joined_pairs()
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                parts = independent_pieces(text, joined)
                yield pd.DataFrame({"key": key, "text": parts, "salt": np.arange(len(parts), dtype=np.int64)})

    return cut


def _count(handed):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = handed.value
        for b in batches:
            texts = [t or "" for t in b["text"]]
            out = np.zeros(len(texts), np.int64)
            start = held = 0
            for i, t in enumerate(texts):
                held += len(t)
                if held > ENCODE_CHARS or i + 1 == len(texts):
                    out[start : i + 1] = model.counts(texts[start : i + 1])
                    start, held = i + 1, 0
            yield pd.DataFrame({"key": b["key"], "tokens": out})

    return count


def token_counts(rows: DataFrame, key: str, model: BpeModel) -> DataFrame:
    """(key, tokens) of each row of ``rows`` by its unique ``key``; the column ``text`` is counted."""
    kind = dict(rows.dtypes)[key]
    handed = rows.sparkSession.sparkContext.broadcast(model)
    texts = rows.select(F.col(key).alias("key"), "text")
    schema = f"key {kind}, tokens long"
    size = F.octet_length("text")
    small = texts.where(F.coalesce(size, F.lit(0)) <= LARGE).mapInPandas(_count(handed), schema)
    pieces = texts.where(size > LARGE).mapInPandas(_cut(handed), f"key {kind}, text string, salt long").repartition("key", "salt")
    large = pieces.mapInPandas(_count(handed), schema).groupBy("key").agg(F.sum("tokens").alias("tokens"))
    return small.unionByName(large).withColumnRenamed("key", key)


def one_spelling(label: Column) -> Column:
    """A label without differences of letter case, blanks, hyphens and underscores; blank labels are null."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, "[\\s\\u00a0\\u3000]+", " "))), "[ _-]+", "_")
    return F.when(plain != "", plain)


# Labels that say that the language isn't known.
UNKNOWN = ("und", "unknown", "xx")


def row_tokens(records: DataFrame, probes: DataFrame, sources: DataFrame, merges: DataFrame) -> DataFrame:
    """(origin, id, source, language, domain, tokens) of each id of records and probes."""
    model = model_of(merges)
    dated = sources.select(one_spelling(F.col("source")).alias("source"), one_spelling(F.col("language")).alias("l"), one_spelling(F.col("domain")).alias("d"))
    by_source = dated.where("source is not null").groupBy("source").agg(F.min("l").alias("source_language"), F.min("d").alias("source_domain"))
    known = records.where("id is not null").groupBy("id").agg(
        F.min(one_spelling(F.col("source"))).alias("source"), F.min(one_spelling(F.col("meta")["language"])).alias("language"), F.min(one_spelling(F.col("meta")["domain"])).alias("domain")
    )
    labelled = known.join(by_source, "source", "left").select(
        "id", "source", F.coalesce(F.when(~F.col("language").isin(*UNKNOWN), F.col("language")), "source_language").alias("language"), F.coalesce("domain", "source_domain").alias("domain")
    )
    of_records = token_counts(records.where("id is not null"), "id", model).groupBy("id").agg(F.max("tokens").alias("tokens"))
    probe_labels = probes.where("id is not null").groupBy("id").agg(F.min(one_spelling(F.col("language"))).alias("language"), F.min(one_spelling(F.col("domain"))).alias("domain"))
    of_probes = token_counts(probes.where("id is not null"), "id", model).groupBy("id").agg(F.max("tokens").alias("tokens"))
    left = labelled.join(of_records, "id").select(F.lit("records").alias("origin"), "id", "source", "language", "domain", "tokens")
    right = probe_labels.join(of_probes, "id").select(F.lit("probes").alias("origin"), "id", F.lit(None).cast("string").alias("source"), F.when(~F.col("language").isin(*UNKNOWN), F.col("language")).alias("language"), "domain", "tokens")
    return left.unionByName(right)


def token_totals(rows: DataFrame) -> DataFrame:
    """Totals of ``row_tokens`` by origin and source, and by origin, language and domain."""
    grouped = rows.groupingSets(
        [("origin",), ("origin", "source"), ("origin", "language", "domain"), ("origin", "language"), ("origin", "domain")],
        "origin", "source", "language", "domain",
    )
    level = F.grouping_id("origin", "source", "language", "domain")
    totals = grouped.agg(level.cast("int").alias("level"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    name = F.element_at(F.create_map(F.lit(7), F.lit("all"), F.lit(3), F.lit("source"), F.lit(4), F.lit("language+domain"), F.lit(5), F.lit("language"), F.lit(6), F.lit("domain")), F.col("level"))
    return totals.select("origin", name.alias("slice"), "source", "language", "domain", "rows", "tokens").where((F.col("slice") != "source") | (F.col("origin") == "records"))
