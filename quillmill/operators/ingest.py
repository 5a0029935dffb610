"""Raw texts to records, and the filters that follow."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as X


def ingest(texts: DataFrame, source: str, start_index: int = 0) -> DataFrame:
    """Records (id, text, source, meta, pos) of (pos, text); empty texts are dropped, but keep their index.

    Null texts count as empty. An empty table gives none."""
    if start_index < 0:
        raise ValueError("start_index must be non-negative")
    index = F.col("pos") + F.lit(start_index)
    clean = texts.select("pos", X.normalize_text(F.col("text")).alias("text")).where("text <> ''")
    return clean.select(
        X.record_id(F.lit(source), index, F.col("text")).alias("id"), "text", F.lit(source).alias("source"), F.lit(None).cast("map<string,string>").alias("meta"), "pos"
    )


@dataclass(frozen=True)
class QualityLimits:
    """Limits of the quality filter; None turns one off. A value equal to its limit passes."""

    min_chars: int | None = 1
    max_chars: int | None = None
    max_symbol_ratio: float | None = None
    max_whitespace_ratio: float | None = None
    max_repeat_line_ratio: float | None = None

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> QualityLimits:
        """Limits of a configuration, over the defaults; other keys are ignored."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})

    def condition(self, text: Column) -> Column:
        """Cheap checks first: evaluation stops at the first that fails."""
        ok = F.lit(True)
        if self.min_chars is not None:
            ok = ok & (F.length(text) >= self.min_chars)
        if self.max_chars is not None:
            ok = ok & (F.length(text) <= self.max_chars)
        for limit, measure in ((self.max_symbol_ratio, X.symbol_ratio), (self.max_whitespace_ratio, X.whitespace_ratio), (self.max_repeat_line_ratio, X.repeat_line_ratio)):
            if limit is not None:
                ok = ok & (measure(text) <= F.lit(float(limit)))
        return ok


def quality_filter(records: DataFrame, limits: QualityLimits | None = None) -> DataFrame:
    """Records within the limits; a null text never passes."""
    return records.where(F.coalesce((limits or QualityLimits()).condition(F.col("text")), F.lit(False)))


def quality_ratios(records: DataFrame, key: str) -> DataFrame:
    """Counts behind the ratios, as whole numbers: characters, symbols, white space, lines, repeated lines."""
    t = F.col("text")
    return records.select(
        key, X.characters(t).alias("chars"), X.symbol_count(t).alias("symbols"), X.whitespace_count(t).alias("whitespace"), X.line_count(t).alias("lines"), X.repeated_lines(t).alias("repeated_lines")
    )
