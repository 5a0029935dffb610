"""The corpus pipeline: ingest, dedup, filter, decontaminate, aggregate, as one lazy chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillmill.operators.contamination import flag_contaminated
from quillmill.operators.dedup import exact_dedup, near_dedup
from quillmill.operators.ingest import QualityLimits, ingest, quality_filter
from quillmill.operators.report import corpus_report
from quillmill.plans.durable import cut


@dataclass(frozen=True)
class Pipeline:
    """Settings of a run. ``near_threshold`` None leaves near duplicates in."""

    source: str = "corpus"
    start_index: int = 0
    near_threshold: float | None = 0.8
    ngram: int = 5
    limits: QualityLimits = field(default_factory=QualityLimits)
    contamination_threshold: float = 0.8

    def records(self, texts: DataFrame, benchmarks: DataFrame) -> DataFrame:
        """Clean records of (pos, text)."""
        # Read by every later step more than once: a written table instead of repeated normalisation.
        rows = cut(ingest(texts, self.source, self.start_index), "ingested")
        rows = exact_dedup(rows) if self.near_threshold is None else near_dedup(rows, self.near_threshold, self.ngram)
        rows = quality_filter(rows, self.limits)
        flagged = flag_contaminated(rows, benchmarks, "id", self.contamination_threshold, self.ngram)
        return flagged.where("not contaminated")

    def report(self, texts: DataFrame, benchmarks: DataFrame) -> DataFrame:
        return corpus_report(self.records(texts, benchmarks))
