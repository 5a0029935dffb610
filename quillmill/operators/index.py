"""The index of evaluation texts that must stay out of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import normalize_text

#: Answers shorter than this say too little to protect.
ANSWER_LEAST = 5


def benchmark_index(probes: DataFrame, tasks: DataFrame, suite: str = "smoke-scored", least: int = ANSWER_LEAST) -> DataFrame:
    """(id, text, source) of probes, prompts and longer answers; of equal normalised texts the first candidate stays.

    ``probes`` and ``tasks`` have their place in ``pos``. Null and blank texts are left out."""
    wide = tasks.select("id", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("prompt").alias("field"), F.col("prompt").alias("text")),
        F.struct(F.lit(1).alias("part"), F.lit("answer").alias("field"), F.col("answer").alias("text")),
    )).alias("x")).select("id", "pos", "x.*")
    of_tasks = wide.select(F.concat(F.lit(f"{suite}:"), "id", F.lit(":"), "field").alias("id"), "text", F.concat(F.lit(f"{suite}/"), "field").alias("source"), F.lit(1).alias("table"), "pos", "part")
    of_probes = probes.select(F.concat(F.lit("probes:"), "id").alias("id"), "text", F.lit("probes/text").alias("source"), F.lit(0).alias("table"), "pos", F.lit(0).alias("part"))
    both = of_probes.unionByName(of_tasks).withColumn("norm", normalize_text(F.col("text")))
    kept = both.where((F.col("norm") != "") & ((F.col("part") == 0) | (F.length("norm") >= least)))
    first = Window.partitionBy(F.sha1("norm")).orderBy("table", "pos", "part")
    return kept.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select("id", "text", "source")
