"""Scans and sinks of the line formats: records, raw texts, benchmarks, probes, corpora, suites.

Schemas are explicit, never inferred. Every reader checks its rows with one aggregation that counts violations, and
raises a ``ValueError`` with a few examples; nothing is collected but those. Lines end at ``\\r\\n``, ``\\r`` or
``\\n`` only."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions.metrics import METRICS
from quillmill.functions.text import record_json, strip
from quillmill.plans.durable import cut

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "source")] + [T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
PROBE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "language", "domain", "text")])
CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "language", "domain", "source", "text")])
SUITE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "area", "language", "prompt", "answer", "metric")] + [T.StructField("choices", T.ArrayType(T.StringType()))])
_CORRUPT, _PLACE = "_corrupt", "_place"


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, _place) of the lines of text files: the place orders them by argument, file and line."""
    parts = None
    for number, path in enumerate(paths):
        place = F.struct(F.lit(number).alias("argument"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
        rows = spark.read.text(path).select("value", place.alias(_PLACE))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _json(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Fields of JSON lines with their places; a string field of another type is null, and ``_corrupt`` holds a line
    that is no object. Blank lines are skipped."""
    rows = _lines(spark, paths).where(strip(F.col("value")) != "").withColumn("_v", F.try_parse_json("value"))
    fields = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            kind = F.schema_of_variant(F.variant_get("_v", f"$.{f.name}", "variant"))
            fields.append(F.when(kind == "STRING", F.try_variant_get("_v", f"$.{f.name}", "string")).alias(f.name))
        else:
            fields.append(F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name))
    whole = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    extra = [F.variant_get("_v", "$.meta", "variant").alias("_meta")] if "meta" in schema.names else []
    return rows.select(*fields, *extra, F.when(~whole, F.col("value")).alias(_CORRUPT), _PLACE)


def _where(rows: DataFrame, bad: Column) -> str:
    """``path:line`` of the first row that breaks a rule."""
    if _PLACE not in rows.columns:
        return ""
    first = rows.where(bad).select(_PLACE).orderBy(_PLACE).first()[_PLACE]
    files = rows.sparkSession.read.text(first["path"]).select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    line = first["line"] & ((1 << 33) - 1)
    before = files.where((F.col("start") < first["start"]) | ((F.col("start") == first["start"]) & (F.col("line").bitwiseAND(F.lit((1 << 33) - 1)) <= line))).count()
    return f"{first['path']}:{before}: "


def require(rows: DataFrame, rules: dict[str, Column], key: str | None = None) -> DataFrame:
    """``rows`` unchanged if no row breaks a rule and no ``key`` occurs twice; raises ``ValueError`` otherwise."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()], F.count("*").alias("_rows")).first()
    broken = [f"{_where(rows, ~F.coalesce(rules[name], F.lit(False)))}{name} ({counts[name]} rows)" for name in rules if counts[name]]
    if key is not None:
        twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(3).collect()
        broken += [f"{_last_place(rows, key, r[key])}duplicate {key}: {r[key]!r}" for r in twice]
    if broken:
        raise ValueError("invalid rows: " + "; ".join(broken))
    return rows


def _last_place(rows: DataFrame, key: str, value: str) -> str:
    """``path:line`` of the last row with this key."""
    if _PLACE not in rows.columns:
        return ""
    last = rows.where(F.col(key) == value).agg(F.max(_PLACE).alias(_PLACE)).first()[_PLACE]
    return _where(rows, F.col(_PLACE) == F.struct(*[F.lit(last[c]).alias(c) for c in ("argument", "path", "start", "line")]))


def _filled(*columns: str) -> dict[str, Column]:
    return {f"{c} must be a non-empty string": F.length(c) > 0 for c in columns}


def read_records(spark: SparkSession, *paths: str, check: bool = True, ordered: bool = False) -> DataFrame:
    """Records of JSON lines; unknown keys are dropped, blank lines skipped. Ids must be distinct over all files.

    ``id``, ``text`` and ``source`` must be strings and ``meta`` an object; the error names path and line. With
    ``ordered`` rows have ``pos``: their place over all files in the order given."""
    rows = _json(spark, paths, RECORD)
    if check:
        plain = F.col("_meta").isNull() | F.schema_of_variant("_meta").startswith("OBJECT")
        rows = require(rows, {"line is not a JSON object": F.col(_CORRUPT).isNull()} | _filled("id", "text", "source") | {"meta must be an object": plain}, "id")
    rows = rows.drop(_CORRUPT, "_meta")
    return with_positions(rows, _PLACE).drop(_PLACE) if ordered else rows.drop(_PLACE)


def with_positions(rows: DataFrame, *order: str) -> DataFrame:
    """A dense ``pos`` in the order of the given columns (or of the partitions).

    The sorted rows are written once; a row's place is its number in its file after the rows of the files before.
    Only the files' row counts pass through the driver."""
    placed = cut(rows.orderBy(*order) if order else rows, "placed")
    file, number = F.element_at(F.split("_metadata.file_path", "/"), -1), F.col("_metadata.row_index")
    numbered = placed.select("*", file.alias("_file_name"), number.alias("_row"))
    counts = sorted((r["_file_name"], r["n"]) for r in numbered.groupBy("_file_name").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for name, n in counts:
        starts.append((name, total))
        total += n
    first = rows.sparkSession.createDataFrame(starts, "_file_name string, _first long")
    return numbered.join(F.broadcast(first), "_file_name").select(*rows.columns, (F.col("_first") + F.col("_row")).alias("pos"))


def read_input_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(pos, text) of raw inputs, files in the order given: ``text`` of JSON lines, each line of any other file."""
    parts = None
    for number, path in enumerate(paths):
        if path.endswith(".jsonl"):
            rows = _json(spark, [path], T.StructType([T.StructField("text", T.StringType())]))
            rows = require(rows, {"line is not a JSON object": F.col(_CORRUPT).isNull(), "text must be a string": F.col("text").isNotNull()})
        else:
            rows = _lines(spark, [path]).withColumnRenamed("value", "text")
        rows = rows.select("text", F.lit(number).alias("_file"), _PLACE)
        parts = rows if parts is None else parts.unionByName(rows)
    return with_positions(parts, "_file", _PLACE).select("pos", "text")


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Texts that must stay out of training: JSON lines, or one text per line; blank ones are skipped."""
    if path.endswith(".jsonl"):
        rows = _json(spark, [path], T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))
        rows = require(rows, {"line is not a JSON object": F.col(_CORRUPT).isNull()} | _filled("text"))
        return rows.select("id", "text").where(strip(F.col("text")) != "")
    rows = spark.read.text(path).select(F.col("value").alias("text"))
    return rows.where(strip(F.col("text")) != "").select(F.sha1("text").alias("id"), "text")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Tokenizer probes; every field filled, ids distinct, at least one row."""
    rows = require(_json(spark, [path], PROBE), {"line is not a JSON object": F.col(_CORRUPT).isNull()} | _filled("id", "language", "domain", "text"), "id").drop(_CORRUPT, _PLACE)
    if rows.isEmpty():
        raise ValueError(f"{path}: no probes found")
    return rows


def read_corpus(spark: SparkSession, path: str, needed: Sequence[str] = ("id", "language", "domain", "text")) -> DataFrame:
    """Corpus rows; the ``needed`` fields must be there. A file that isn't JSON lines gives its non-empty lines."""
    if not path.endswith(".jsonl"):
        return spark.read.text(path).select(F.col("value").alias("text")).where("text <> ''")
    rows = require(_json(spark, [path], CORPUS), {"line is not a JSON object": F.col(_CORRUPT).isNull()} | {f"{c} is missing": F.col(c).isNotNull() for c in needed}).drop(_CORRUPT, _PLACE)
    if rows.isEmpty():
        raise ValueError(f"{path}: empty corpus")
    return rows


def suite_rules(metrics: Sequence[str] = tuple(METRICS)) -> dict[str, Column]:
    """What every task of a scored suite must fulfil."""
    choices = F.transform("choices", strip)
    return _filled("id", "area", "language", "prompt") | {
        "metric is unknown": F.col("metric").isin(*metrics),
        "answer must not be blank": F.length(strip(F.col("answer"))) > 0,
        "multiple choice needs choices that hold the answer": (F.col("metric") != "multiple_choice") | F.coalesce((F.size("choices") > 0) & F.array_contains(choices, strip(F.col("answer"))), F.lit(False)),
    }


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a scored suite, checked; at least one."""
    rows = require(_json(spark, [path], SUITE), {"line is not a JSON object": F.col(_CORRUPT).isNull()} | suite_rules(), "id").drop(_CORRUPT, _PLACE)
    if rows.isEmpty():
        raise ValueError(f"{path}: no tasks found")
    return rows


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of whole files, for the cleaners."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"))


def read_json_object(path: str | Path) -> dict:
    """A configuration file (JSON, or YAML that is JSON); its root must be an object."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: not JSON-compatible YAML: {e}") from e
    if not isinstance(value, dict):
        raise ValueError(f"{path}: root must be an object")
    return value


def write_records(rows: DataFrame, path: str, order: str | None = "pos", files: int | None = None) -> None:
    """Records as JSON lines, in order of ``order`` over the files' names; ``files`` = 1 gives a single file."""
    source = F.col("source")
    meta = F.col("meta") if "meta" in rows.columns else F.lit(None).cast("map<string,string>")
    ordered = rows.orderBy(order) if order and order in rows.columns else rows
    lines = ordered.select(record_json(F.col("id"), F.col("text"), source, meta).alias("value"))
    (lines.coalesce(files) if files else lines).write.mode("overwrite").text(path)


def differs(expected: DataFrame, actual: DataFrame) -> bool:
    """Whether two tables hold other rows (as bags)."""
    if expected.columns != actual.columns:
        return True
    maps = [f.name for f in expected.schema.fields if isinstance(f.dataType, T.MapType)]
    plain = {m: F.array_sort(F.map_entries(m)) for m in maps}
    expected, actual = expected.withColumns(plain), actual.withColumns(plain)
    return not (expected.exceptAll(actual).isEmpty() and actual.exceptAll(expected).isEmpty())


def relative_path(path: str | Path, root: str | Path) -> str:
    """``path`` below ``root`` with forward slashes; a path outside keeps only its name."""
    target = Path(path).resolve()
    try:
        return target.relative_to(Path(root).resolve()).as_posix()
    except ValueError:
        return target.name
