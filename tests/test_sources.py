"""Readers, writers, streaming and the registry."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest

from quillmill.operators.ingest import QualityLimits
from quillmill.sources import records as R
from quillmill.sources import reports
from quillmill.streaming import ingest as S

ROOT = Path(__file__).resolve().parents[1]


def lines(path, rows):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in rows), encoding="utf-8")
    return str(path)


def test_records_round_trip(spark, tmp_path):
    rows = [{"id": "b", "text": "é x", "source": "s", "meta": {"k": "v"}, "more": 1}, "", {"id": "a", "text": "t", "source": "s"}]
    got = R.read_records(spark, lines(tmp_path / "r.jsonl", rows))
    assert {(r["id"], r["text"]) for r in got.collect()} == {("b", "é x"), ("a", "t")}
    R.write_records(got, str(tmp_path / "out"), order="id", files=1)
    assert not R.differs(got, R.read_records(spark, str(tmp_path / "out")))


@pytest.mark.parametrize("bad", ["{not json", {"id": "", "text": "t", "source": "s"}, {"id": "a", "source": "s"}, {"id": "x", "text": "t", "source": "s"}])
def test_bad_records(spark, tmp_path, bad):
    with pytest.raises(ValueError):
        R.read_records(spark, lines(tmp_path / "r.jsonl", [{"id": "x", "text": "t", "source": "s"}, bad]))


def test_input_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo\rthree\n\nfour".encode())
    b = lines(tmp_path / "b.jsonl", [{"text": "five"}, {"text": ""}])
    got = [(r["pos"], r["text"]) for r in R.read_input_texts(spark, str(tmp_path / "a.txt"), b).orderBy("pos").collect()]
    assert got == list(enumerate(["one", "two", "three", "", "four", "five", ""]))


def test_order_over_files_of_unequal_size(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", [{"id": f"a{k}", "text": "t", "source": "s"} for k in range(3)])
    b = lines(tmp_path / "b.jsonl", [{"id": f"b{k}", "text": "t" * 300, "source": "s"} for k in range(4000)])
    for paths, want in (((a, b), ["a0", "a1", "a2", "b0"]), ((b, a), ["b0", "b1", "b2", "b3"])):
        got = R.read_records(spark, *paths, ordered=True).orderBy("pos").select("pos", "id").collect()
        assert [r["pos"] for r in got] == list(range(4003)) and [r["id"] for r in got[:4]] == want
        assert [r["id"] for r in got if r["id"][0] == "b"] == [f"b{k}" for k in range(4000)]


@pytest.mark.parametrize("change, message", [({"id": 7}, "id must be"), ({"text": {"x": 1}}, "text must be"), ({"source": ["s"]}, "source must be"), ({"source": None}, "source must be"), ({"meta": ["k"]}, "meta must be")])
def test_errors_name_path_and_line(spark, tmp_path, change, message):
    good = {"id": "x", "text": "t", "source": "s", "meta": {"k": 1}}
    path = lines(tmp_path / "r.jsonl", [good, "", good | {"id": "y"} | change, good | {"id": "z"} | change])
    with pytest.raises(ValueError, match=f"r.jsonl:3: {message}"):
        R.read_records(spark, path)
    for rows, where in (([good, good | {"id": "y"}, good], "r.jsonl:3: duplicate id"), ([good, "[1]"], "r.jsonl:2: line is not"), ([good, "{"], "r.jsonl:2: line is not")):
        with pytest.raises(ValueError, match=where):
            R.read_records(spark, lines(tmp_path / "r.jsonl", rows))
    with pytest.raises(ValueError, match="t.jsonl:2: text must be"):
        R.read_input_texts(spark, lines(tmp_path / "t.jsonl", [{"text": ""}, {"text": 5}]))


def test_suite_rules(spark, tmp_path):
    good = {"id": "1", "area": "a", "language": "en", "prompt": "p", "answer": "B", "metric": "multiple_choice", "choices": ["A", "B "]}
    assert R.read_suite(spark, lines(tmp_path / "s.jsonl", [good])).count() == 1
    for change in ({"metric": "x"}, {"answer": " "}, {"choices": ["A"]}, {"choices": []}):
        with pytest.raises(ValueError):
            R.read_suite(spark, lines(tmp_path / "s.jsonl", [good | change]))
    with pytest.raises(ValueError):
        R.read_suite(spark, lines(tmp_path / "e.jsonl", []))


def test_reports():
    text = reports.render_markdown("T", {"n": 1, "by": {"a": {"x": 1}, "b": {"x": None}}})
    assert "# T" in text and "| a | 1 |" in text and "| b | - |" in text
    assert reports.rounded(1, 160) == 0.0063 and reports.rounded(1, 0) == 0.0
    assert R.relative_path("/a/b/c", "/a") == "b/c" and R.relative_path("/x/y", "/a") == "y"


def test_streaming_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("a", "same text"), ("b", "same text "), ("c", "other"), ("d", None)], "id string, text string").selectExpr("*", "timestamp'2025-01-01' as ingested_at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = S.clean_stream(S.read_stream(spark, str(tmp_path / "in"), rows.schema), QualityLimits(min_chars=3))
    S.run_available(stream.select("id", "text"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["other", "same text"]


def test_library_stands_without_llm():
    code = "import sys; sys.modules['quillmill.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'p4' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_oracle_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
