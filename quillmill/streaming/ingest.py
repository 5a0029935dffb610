"""Streaming forms of the stateless steps, and exact dedup within a bounded time.

An extension: new files of records flow through normalisation, filter and contamination flag into a sink; repeated
texts are dropped while their first arrival is younger than the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillmill.functions.text import content_hash, normalize_text
from quillmill.operators.ingest import QualityLimits, quality_filter


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(records: DataFrame, limits: QualityLimits | None = None, time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Normalised records within the limits, each text once within ``delay`` of its first arrival."""
    clean = records.withColumn("text", normalize_text(F.col("text"))).where("text <> ''")
    kept = quality_filter(clean, limits).withColumn("_h", content_hash(F.col("text")))
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")


def counts_by_day(records: DataFrame, time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Records and characters per day and source; days close once the watermark has passed them."""
    return (
        records.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "source").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("chars"))
    )


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; the checkpoint makes a rerun go on where this one ended."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
