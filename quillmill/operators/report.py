"""Composition of a corpus: totals over everything and by group, additive over shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X


def corpus_report(records: DataFrame, by: str = "source") -> DataFrame:
    """(by, records, chars, bytes, total): one row per value of ``by`` and one for all (``total`` true).

    A null text adds no characters; a null group is a group of its own. The mean is ``chars / records``."""
    measured = records.select(by, X.characters(F.col("text")).alias("c"), X.utf8_bytes(F.col("text")).alias("b"))
    grouped = measured.rollup(by).agg(F.count("*").alias("records"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), (F.grouping(by) == 1).alias("total"))
    return grouped.select(by, "records", "chars", "bytes", "total")


def merge_reports(*parts: DataFrame) -> DataFrame:
    """The report of the union of shards, from their reports: all columns but the group are added."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    by = both.columns[0]
    return both.groupBy(by, "total").agg(*[F.sum(c).alias(c) for c in ("records", "chars", "bytes")]).select(by, "records", "chars", "bytes", "total")


def duplicate_ids(*shards: DataFrame) -> DataFrame:
    """Ids that occur more than once over all shards."""
    ids = shards[0].select("id")
    for s in shards[1:]:
        ids = ids.unionByName(s.select("id"))
    return ids.groupBy("id").agg(F.count("*").alias("times")).where("times > 1")


def probe_summary(probes: DataFrame) -> DataFrame:
    """(language, domain, level, probes, chars, bytes): over all probes, by language and by domain."""
    measured = probes.select("language", "domain", X.characters(F.col("text")).alias("c"), X.utf8_bytes(F.col("text")).alias("b"))
    return measured.groupingSets([(), ("language",), ("domain",)], "language", "domain").agg(
        F.grouping_id("language", "domain").alias("level"), F.count("*").alias("probes"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    )


def kept_and_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of a step: before, kept, removed."""
    n = before.agg(F.count("*").alias("total")).crossJoin(after.agg(F.count("*").alias("kept")))
    return n.select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"))
