"""Command line: ``python -m quillmill COMMAND ...``. Inputs are JSON lines (or text where noted), outputs JSON lines,
JSON or Markdown reports."""

from __future__ import annotations

import argparse
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.bpe import BpeModel
from quillmill.operators import contamination, dedup, governance, index, splits, tokenizer
from quillmill.operators.ingest import QualityLimits, ingest, quality_filter
from quillmill.plans import reports
from quillmill.plans.durable import cut
from quillmill.plans.session import local_session, ship
from quillmill.sources import records as R
from quillmill.sources.reports import render_json, render_markdown, save


def _ordered(spark: SparkSession, paths: list[str]) -> DataFrame:
    return cut(R.read_records(spark, *paths, ordered=True), "input")


def _write(rows: DataFrame, path: str, total: int | None = None) -> None:
    rows = cut(rows, "output")
    R.write_records(rows, path, files=1)
    kept = rows.count()
    print(f"kept {kept}" + (f", removed {total - kept}" if total is not None else ""))


def _report(value: Any, args: argparse.Namespace, title: str) -> None:
    text = render_markdown(title, value) if args.format == "markdown" else render_json(value)
    if args.output:
        save(text, args.output)
    else:
        print(text, end="")


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must be in [0, 1]")
    return value


def _count(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run one command; the return value is the process's exit code."""
    c = args.command
    if c == "ingest":
        texts = cut(R.read_input_texts(spark, *args.inputs), "texts")
        _write(ingest(texts, args.source, args.start_index), args.output, texts.count())
    elif c == "dedup":
        rows = _ordered(spark, args.inputs)
        _write(dedup.exact_dedup(rows) if args.exact else dedup.near_dedup(rows, args.threshold, args.ngram), args.output, rows.count())
    elif c == "filter":
        rows = _ordered(spark, args.inputs)
        limits = QualityLimits.from_dict(R.read_json_object(args.config)) if args.config else QualityLimits()
        _write(quality_filter(rows, limits), args.output, rows.count())
    elif c == "decontaminate":
        rows = _ordered(spark, args.inputs)
        flagged = contamination.flag_contaminated(rows, R.read_benchmarks(spark, args.benchmarks), "id", args.threshold, args.ngram)
        noted = flagged.withColumn("meta", F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,string>")), F.create_map(F.lit("contaminated"), F.col("contaminated").cast("string"), F.lit("contamination_score"), F.col("contamination_score").cast("string"))))
        _write(noted.where(~F.col("contaminated")) if args.remove else noted, args.output, rows.count())
    elif c == "aggregate":
        _report(reports.corpus(*[R.read_records(spark, p) for p in args.inputs]), args, "Corpus report")
    elif c == "load":
        rows = _ordered(spark, args.inputs)
        placed = splits.buffered_load_order(rows, args.seed, args.buffer, args.start) if args.buffer else splits.load_order(rows, args.seed, args.start)
        placed = placed.where(F.col("ord") < args.start + args.limit) if args.limit is not None else placed
        _write(placed.drop("pos").withColumnRenamed("ord", "pos"), args.output)
    elif c == "index":
        probes = R.with_positions(R.read_probes(spark, args.probes))
        built = index.benchmark_index(probes, R.with_positions(R.read_suite(spark, args.suite))).withColumn("pos", F.col("id"))
        if args.check:
            same = not R.differs(built.select("id", "text", "source"), R.read_records(spark, args.output).select("id", "text", "source"))
            print("in sync" if same else "out of date")
            return 0 if same else 1
        _write(built, args.output)
    elif c == "train-bpe":
        model = tokenizer.train_bpe(R.read_corpus(spark, args.inputs[0], ["text"]).select("text"), args.vocab_size)
        model.save(args.output)
        print(reports.train_summary(model, args.vocab_size))
    elif c == "score-tokenizer":
        extra = {"model": tokenizer.token_count(BpeModel.load(args.model))} if args.model else {}
        _report(reports.compression(R.read_probes(spark, args.probes), tokenizer.TOKENIZERS | extra), args, "Tokenizer compression")
    elif c == "select-tokenizer":
        texts = R.read_corpus(spark, args.corpus, ["text"]) if args.corpus else None
        _report(reports.selection(R.read_probes(spark, args.probes), args.vocab_sizes, texts), args, "Tokenizer selection")
    elif c == "bakeoff":
        _report(reports.bakeoff(R.read_corpus(spark, args.corpus), args.vocab_sizes, args.d_model, args.eval_frac), args, "Vocabulary comparison")
    elif c == "lm":
        _report(reports.language_model(R.read_corpus(spark, args.corpus, ["language", "text"]), args.orders, args.eval_frac, args.smoke), args, "Language model")
    elif c == "suite":
        _report(reports.scored_suite(R.read_suite(spark, args.suite), args.predictor), args, "Scored suite")
    elif c == "haystack":
        _report(reports.haystack(spark, args.lengths, args.depths, args.predictor), args, "Long context")
    elif c == "evaluate":
        result = reports.evaluate(R.read_suite(spark, args.suite), R.read_corpus(spark, args.corpus, ["language", "text"]), args.predictor, args.smoke)
        _report(result, args, "Evaluation")
        wrong = reports.reference_invariants(result, args.predictor) if args.assert_reference else []
        print("\n".join(wrong), file=sys.stderr)
        return 1 if wrong else 0
    return 0


def check(args: argparse.Namespace) -> int:
    """Commands on small JSON objects, without a session."""
    value = R.read_json_object(args.inputs[0])
    bad = {"check-manifest": governance.manifest_violations, "check-checkpoint": governance.checkpoint_violations, "check-config": governance.config_violations}[args.command](value)
    print("\n".join(bad) or "valid")
    return 1 if bad else 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple, inputs: str | None = "+", output: bool | None = True) -> None:
        p = commands.add_parser(name)
        if inputs:
            p.add_argument("inputs", nargs=inputs)
        if output is not None:
            p.add_argument("--output", required=output)
        if output is False:
            p.add_argument("--format", choices=("json", "markdown"), default="json")
        for flag, options in flags:
            p.add_argument(flag, **options)

    near = [("--threshold", {"type": _share, "default": 0.8}), ("--ngram", {"type": int, "default": 5})]
    sizes, corpus_file = ("--vocab-sizes", {"type": int, "nargs": "+", "default": [512, 1024]}), ("--corpus", {"required": True})
    frac, smoke, who = ("--eval-frac", {"type": float, "default": 0.12}), ("--smoke", {"action": "store_true"}), ("--predictor", {"choices": ("gold", "empty", "echo", "mock"), "default": "gold"})
    add("ingest", ("--source", {"required": True}), ("--start-index", {"type": _count, "default": 0}))
    add("dedup", *near, ("--exact", {"action": "store_true"}))
    add("filter", ("--config", {}))
    add("decontaminate", ("--benchmarks", {"required": True}), ("--threshold", {"type": float, "default": 0.8}), near[1], ("--remove", {"action": "store_true"}))
    add("aggregate", output=False)
    add("load", ("--seed", {"type": int}), ("--buffer", {"type": _count, "default": 0}), ("--start", {"type": _count, "default": 0}), ("--limit", {"type": _count}))
    add("index", ("--probes", {"required": True}), ("--suite", {"required": True}), ("--check", {"action": "store_true"}), inputs=None)
    add("train-bpe", ("--vocab-size", {"type": int, "required": True}))
    add("score-tokenizer", ("--probes", {"required": True}), ("--model", {}), inputs=None, output=False)
    add("select-tokenizer", ("--probes", {"required": True}), ("--corpus", {}), sizes, inputs=None, output=False)
    add("bakeoff", corpus_file, sizes, frac, ("--d-model", {"type": int, "default": 2048}), inputs=None, output=False)
    add("lm", corpus_file, ("--orders", {"type": int, "nargs": "+", "default": [0, 1, 2, 3]}), frac, smoke, inputs=None, output=False)
    add("suite", ("--suite", {"required": True}), who, inputs=None, output=False)
    add("haystack", ("--lengths", {"type": int, "nargs": "+", "default": [200, 1000, 4000]}), ("--depths", {"type": float, "nargs": "+", "default": [0.0, 0.25, 0.5, 0.75, 1.0]}), who, inputs=None, output=False)
    add("evaluate", ("--suite", {"required": True}), corpus_file, who, smoke, ("--assert-reference", {"action": "store_true"}), inputs=None, output=False)
    for name in ("check-manifest", "check-checkpoint", "check-config"):
        add(name, inputs=1, output=None)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command.startswith("check-"):
        return check(args)
    spark = ship(local_session())
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
