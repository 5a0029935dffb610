"""Scored suites, long-context retrieval grids, and their reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.metrics import Metric, score
from quillmill.functions.text import mock_answer, strip, truncated

Predictor = Callable[[DataFrame], Column]
#: Reference predictors by name: a column over the task's columns. A real model is a column of predictions joined on.
PREDICTORS: dict[str, Predictor] = {
    "gold": lambda t: t["answer"],
    "empty": lambda t: F.lit(""),
    "echo": lambda t: t["prompt"],
    "mock": lambda t: mock_answer(t["prompt"]),
}


def run_suite(tasks: DataFrame, predictor: Predictor | str = "gold", metrics: dict[str, Metric] | None = None) -> DataFrame:
    """(id, area, language, metric, passed, prediction): each task scored by its own metric; predictions are cut to
    120 characters."""
    prediction = (PREDICTORS[predictor] if isinstance(predictor, str) else predictor)(tasks)
    return tasks.select("id", "area", "language", "metric", score(F.col("metric"), prediction, F.col("answer"), metrics).alias("passed"), truncated(prediction).alias("prediction"))


def joined_predictions(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tasks with ``prediction`` of a model, by id; a task without one has an empty prediction."""
    return tasks.join(predictions.select("id", "prediction"), "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def accuracy(scored: DataFrame) -> DataFrame:
    """(level, area, language, passed, total) over all, by area and by language."""
    sums = scored.groupingSets([(), ("area",), ("language",)], "area", "language").agg(
        F.grouping_id("area", "language").alias("_g"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"), F.count("*").alias("total")
    )
    return sums.select(F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "area").otherwise("language").alias("level"), "area", "language", "passed", "total")


def known_failures(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("passed")).select("id")


# Sentences that fill a haystack.
FILLER = (
    "The archive contains routine maintenance logs from the facility.",
    "Daily status reports were filed on schedule without incident.",
    "倉庫の在庫は定期的に点検され記録されている。",
    "Shipments were processed and the manifests were reconciled.",
    "会議の議事録は共有フォルダに保管されている。",
    "The weather remained mild throughout the reporting period.",
)
DEFAULT_LENGTHS, DEFAULT_DEPTHS = (200, 1000, 4000), (0.0, 0.25, 0.5, 0.75, 1.0)
#: What a needle's value begins with.
NEEDLE_PREFIX = "NEEDLE"


def haystack_tasks(spark: SparkSession, lengths: Sequence[int] = DEFAULT_LENGTHS, depths: Sequence[float] = DEFAULT_DEPTHS, prefix: str = NEEDLE_PREFIX) -> DataFrame:
    """One retrieval task per length and depth: filler text of that length with a needle at that depth.

    Lengths and depths are made distinct and sorted; the needle of each cell is its own."""
    cycle = " ".join(FILLER) + " "
    grid = spark.createDataFrame([(int(x),) for x in sorted(set(lengths))], "length int").crossJoin(spark.createDataFrame([(float(d),) for d in sorted(set(depths))], "depth double"))
    cells = grid.withColumn("idx", F.row_number().over(_by_cell()) - 1)
    filler = F.substring(F.repeat(F.lit(cycle), F.floor(F.col("length") / len(cycle)).cast("int") + 1), F.lit(1), F.col("length"))
    filler = F.when(F.col("length") > 0, filler).otherwise(F.lit(""))
    value = F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha1(F.concat(F.lit("niah-needle-"), F.col("idx").cast("string"))), 1, 8)))
    name = F.concat(F.lit("access-code-"), F.col("idx").cast("string"))
    built = cells.select("length", "depth", filler.alias("filler"), value.alias("answer"), name.alias("key")).withColumn("at", F.floor(F.col("depth") * F.length("filler")).cast("int"))
    statement = F.concat(F.lit("Note: the secret "), "key", F.lit(" is "), "answer", F.lit("."))
    hay = F.concat(F.substring("filler", F.lit(1), F.col("at")), F.lit(" "), statement, F.lit(" "), F.substring("filler", F.col("at") + 1, F.length("filler")))
    question = F.concat(F.lit("What is the secret "), "key", F.lit("? Answer with the value only."))
    return built.select(
        F.concat(F.lit("niah-L"), F.col("length").cast("string"), F.lit("-D"), F.col("depth").cast("string")).alias("id"), F.lit("long_context").alias("area"), F.lit("en").alias("language"),
        F.concat(hay, F.lit("\n\n"), question).alias("prompt"), "answer", F.lit("includes").alias("metric"), "length", "depth", (F.col("at") + 1).alias("needle_pos"),
    )


def _by_cell():
    from pyspark.sql import Window

    return Window.orderBy("length", "depth")


def window_predictor(window: int) -> Predictor:
    """Finds the needle only where it starts within the first ``window`` characters."""
    return lambda t: F.when(t["needle_pos"] < window, t["answer"]).otherwise(F.lit(""))


def haystack_scores(tasks: DataFrame, predictor: Predictor | str = "gold") -> DataFrame:
    """(length, depth, passed) of each cell."""
    prediction = (PREDICTORS[predictor] if isinstance(predictor, str) else predictor)(tasks)
    return tasks.select("length", "depth", score(F.col("metric"), prediction, F.col("answer")).cast("int").alias("passed"))


def haystack_matrix(scores: DataFrame, depths: Sequence[float] | None = None) -> DataFrame:
    """One row per length, one column per depth."""
    named = scores.withColumn("_d", F.concat(F.lit("d"), F.col("depth").cast("string")))
    values = [f"d{float(d)}" for d in sorted(set(depths))] if depths else None
    return named.groupBy("length").pivot("_d", values).agg(F.max("passed"))


def haystack_accuracy(scores: DataFrame) -> DataFrame:
    """(level, length, depth, passed, total) over all, by length and by depth."""
    sums = scores.groupingSets([(), ("length",), ("depth",)], "length", "depth").agg(F.grouping_id("length", "depth").alias("_g"), F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("total"))
    return sums.select(F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "length").otherwise("depth").alias("level"), "length", "depth", "passed", "total")


def smoke_tasks(config: DataFrame) -> DataFrame:
    """Tasks nested in a configuration read as JSON, one row each, with the checks a smoke run reports."""
    tasks = config.select(F.explode("tasks").alias("t")).select("t.*")
    return tasks.select("id", "area", "type", F.lit("validated_not_run").alias("status"))


def mock_report(tasks: DataFrame) -> DataFrame:
    """(id, area, type, output_len, passed): the mock model's answer passes when it isn't blank."""
    out = mock_answer(F.col("prompt"))
    return tasks.select("id", "area", "type", F.length(out).alias("output_len"), (strip(out) != "").alias("passed"))


def score_table(**parts: DataFrame) -> DataFrame:
    """(dimension, passed, total, value) of several evaluations, side by side and never averaged.

    Each part has one row: (passed, total) or (value)."""
    out = None
    for name, part in parts.items():
        col = lambda c, kind: (F.col(c) if c in part.columns else F.lit(None)).cast(kind).alias(c)  # noqa: E731, B023
        row = part.select(F.lit(name).alias("dimension"), col("passed", "long"), col("total", "long"), col("value", "double"))
        out = row if out is None else out.unionByName(row)
    return out


def needle(index: int, prefix: str = NEEDLE_PREFIX) -> tuple[str, str]:
    """Name and value of the needle of one cell."""
    return f"access-code-{index}", f"{prefix}-{hashlib.sha1(f'niah-needle-{index}'.encode()).hexdigest()[:8].upper()}"
