"""Reports and the command line, end to end on small files."""

from __future__ import annotations

import json

import pytest

from quillmill import __main__ as cli
from quillmill.plans import reports


def write(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def command(spark, *argv):
    args = cli.parser().parse_args([str(a) for a in argv])
    return cli.check(args) if args.command.startswith("check-") else cli.run(spark, args)


def read(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]


@pytest.fixture
def files(tmp_path):
    corpus = [{"id": f"{lang}{i:02d}", "language": lang, "domain": "d", "source": "s", "text": t * (i % 3 + 1) + str(i)} for lang, t in (("en", "the cat sat on the mat "), ("ja", "猫が庭で遊ぶ")) for i in range(12)]
    suite = [{"id": "1", "area": "a", "language": "en", "prompt": "How much?", "answer": "144 things", "metric": "includes"}, {"id": "2", "area": "b", "language": "ja", "prompt": "Which?", "answer": "B", "metric": "multiple_choice", "choices": ["A", "B"]}]
    return {"corpus": write(tmp_path / "c.jsonl", corpus), "suite": write(tmp_path / "s.jsonl", suite), "probes": write(tmp_path / "p.jsonl", [{k: r[k] for k in ("id", "language", "domain", "text")} for r in corpus])}


def test_pipeline_commands(spark, tmp_path, capsys):
    texts = ["An English sentence about a lamp.", "An English sentence about a lamp.", " ", "ab", "日本語の文です。", "held out text here"]
    raw, bench = tmp_path / "raw.txt", write(tmp_path / "b.jsonl", [{"text": "held out text here"}])
    raw.write_text("\n".join(texts), encoding="utf-8")
    steps = [tmp_path / f"step{k}" for k in range(4)]
    assert command(spark, "ingest", raw, "--source", "s", "--output", steps[0]) == 0
    assert command(spark, "dedup", steps[0], "--output", steps[1]) == 0
    config = tmp_path / "f.yaml"
    config.write_text('{"min_chars": 3}')
    assert command(spark, "filter", steps[1], "--config", config, "--output", steps[2]) == 0
    assert command(spark, "decontaminate", steps[2], "--benchmarks", bench, "--remove", "--output", steps[3]) == 0
    got = read(steps[3])
    assert [r["text"] for r in got] == [texts[0], texts[4]] and got[0]["meta"]["contaminated"] == "false"
    capsys.readouterr()
    assert command(spark, "aggregate", steps[3]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == 2
    assert command(spark, "load", steps[3], "--seed", 3, "--start", 1, "--output", tmp_path / "order") == 0
    assert len(read(tmp_path / "order")) == 1
    with pytest.raises(ValueError):
        command(spark, "aggregate", steps[3], steps[3])


def test_tokenizer_and_evaluation_commands(spark, tmp_path, files, capsys):
    assert command(spark, "train-bpe", files["corpus"], "--vocab-size", 300, "--output", tmp_path / "m.json") == 0
    capsys.readouterr()
    assert command(spark, "score-tokenizer", "--probes", files["probes"], "--model", tmp_path / "m.json") == 0
    scores = json.loads(capsys.readouterr().out)
    assert scores["byte"]["overall"]["tokens_per_byte"] == 1.0 and scores["model"]["overall"]["tokens_per_byte"] < 0.7
    assert command(spark, "select-tokenizer", "--probes", files["probes"], "--vocab-sizes", 280, 300) == 0
    assert json.loads(capsys.readouterr().out)["recommendation"] is None
    assert command(spark, "bakeoff", "--corpus", files["corpus"], "--vocab-sizes", 270, 300) == 0
    assert json.loads(capsys.readouterr().out)["recommendation"]["name"] in ("bpe-270", "bpe-300")
    assert command(spark, "evaluate", "--suite", files["suite"], "--corpus", files["corpus"], "--smoke", "--assert-reference") == 0
    assert json.loads(capsys.readouterr().out)["score_table"][0]["value"] == 1.0
    assert command(spark, "evaluate", "--suite", files["suite"], "--corpus", files["corpus"], "--predictor", "empty", "--format", "markdown", "--output", tmp_path / "r.md") == 0
    assert "score_table" in (tmp_path / "r.md").read_text()
    assert command(spark, "index", "--probes", files["probes"], "--suite", files["suite"], "--output", tmp_path / "ix") == 0
    assert command(spark, "index", "--probes", files["probes"], "--suite", files["suite"], "--output", tmp_path / "ix", "--check") == 0
    with pytest.raises(ValueError):
        reports.reference_invariants({}, "echo")


def test_check_commands(spark, tmp_path):
    path = tmp_path / "x.yaml"
    path.write_text("{}")
    assert command(spark, "check-manifest", path) == 1 and command(spark, "check-checkpoint", path) == 1 and command(spark, "check-config", path) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["dedup", "a", "--output", "b", "--threshold", "1.5"])
