"""The pN_ queries: each runs its operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import langid, leak, nearsets, overlap, packing, quality, stuffing, tokens, visual

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Records and probes together: (id, text)."""
    records, probes = _table(spark, folder, "records"), _table(spark, folder, "probes")
    return records.select("id", "text").unionByName(probes.select("id", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(_table(spark, folder, "records"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, folder, "records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.look_alikes(_texts(spark, folder))


def p2_form_classes(spark: SparkSession, folder: str) -> DataFrame:
    return visual.form_classes(_texts(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(_table(spark, folder, "records"))


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    records = _table(spark, folder, "records")
    return quality.statistics(records, quality.train(records))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearsets.near_pairs(_table(spark, folder, "records"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return nearsets.near_classes(_table(spark, folder, "records"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Records and probes with their language labels: (id, text, label)."""
    records, probes = _table(spark, folder, "records"), _table(spark, folder, "probes")
    return records.select("id", "text", F.col("meta")["language"].alias("label")).unionByName(probes.select("id", "text", F.col("language").alias("label")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.mislabelled(_labelled(spark, folder))


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.documents(_labelled(spark, folder))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.segments(_labelled(spark, folder))


def p6_row_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.row_tokens(*(_table(spark, folder, t) for t in ("records", "probes", "dataset_sources", "bpe_merges")))


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_totals(p6_row_tokens(spark, folder))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), _table(spark, folder, "context_windows"), tokens.model_of(_table(spark, folder, "bpe_merges")))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, folder), _table(spark, folder, "context_windows"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark_items"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leak.removal_spans(_table(spark, folder, "documents"), _table(spark, folder, "benchmark_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quillmill.llm.oracle import SQL

    return SQL
