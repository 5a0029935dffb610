"""Operators against brute force and their invariants, with nulls, empty tables, repeats and extra columns."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import random_texts

from quillmill.functions.bpe import SPECIAL_TOKENS, BpeModel
from quillmill.functions.metrics import score
from quillmill.operators import contamination, dedup, governance, index, ingest, ngram, report, splits, suite, tokenizer
from quillmill.plans.pipeline import Pipeline

RECORD = "id string, pos long, text string, source string, _h string"


def records(spark, texts):
    return spark.createDataFrame([(f"r{i}", i, t, "s", "clash") for i, t in enumerate(texts)], RECORD)


def grams(t, n):
    return ({t[i : i + n] for i in range(len(t) - n + 1)} or {t}) if t else set()


def share(a, b, n):
    x, y = grams(a, n), grams(b, n)
    return len(x & y) / len(x | y) if x | y else 1.0


def greedy(texts, threshold, n):
    kept = []
    for i, t in enumerate(texts):
        if not any(t == texts[k] or share(t, texts[k], n) >= threshold for k in kept):
            kept.append(i)
    return kept


def near_texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(20, 60))) for _ in range(8)]
    out = []
    for _ in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        out.append("".join(t))
    return [*out, "", "", "ab", "ab"]


@pytest.mark.parametrize("threshold,n", [(0.6, 3), (0.8, 5), (1.0, 2), (0.0, 5)])
def test_near_dedup_is_greedy(spark, threshold, n):
    texts = near_texts(7)
    got = [r["pos"] for r in dedup.near_dedup(records(spark, texts), threshold, n).orderBy("pos").collect()]
    assert got == greedy(texts, threshold, n)


def test_near_dedup_keeps_chain_ends(spark):
    texts = ["abcdefghij", "bcdefghijk", "cdefghijkl"]
    t = share(texts[0], texts[1], 1)
    assert share(texts[0], texts[2], 1) < t
    got = [r["pos"] for r in dedup.near_dedup(records(spark, texts), t, 1).orderBy("pos").collect()]
    assert got == [0, 2]


def test_near_dedup_boundary(spark):
    rows = records(spark, ["abcd", "abce"])
    assert dedup.near_dedup(rows, 0.6, 1).count() == 1
    assert dedup.near_dedup(rows, 0.61, 1).count() == 2


def test_exact_dedup_nulls_and_empty(spark):
    rows = records(spark, ["a", None, "a", None, "", ""])
    assert [r["pos"] for r in dedup.exact_dedup(rows).orderBy("pos").collect()] == [0, 1, 4]
    assert dedup.exact_dedup(rows.limit(0)).count() == 0
    assert dedup.near_dedup(rows.limit(0)).count() == 0


def test_ingest_and_filter(spark):
    texts = ["x", " ", "", "x\r\n y ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string")
    got = ingest.ingest(rows, "s", 5).orderBy("pos").collect()
    assert [(r["pos"], r["text"]) for r in got] == [(0, "x"), (3, "x\n y")]
    limits = ingest.QualityLimits.from_dict({"min_chars": 1, "max_symbol_ratio": 0.5, "other": 1})
    kept = ingest.quality_filter(records(spark, ["a!", "a!!", "", None]), limits)
    assert [r["text"] for r in kept.collect()] == ["a!"]


@pytest.mark.parametrize("joined", [False, True])
def test_contamination(spark, joined):
    docs = ["the quick brown fox", "the quick brown fix", "other words here", "", None, "The exact item"]
    bench = spark.createDataFrame([("b1", "the quick brown fox "), ("b2", "The exact item\n"), ("b3", ""), ("b4", None)], "id string, text string")
    got = {r["pos"]: r for r in contamination.flag_contaminated(records(spark, docs), bench, "id", 0.6, 5, joined).collect()}
    for i, d in enumerate(docs):
        want = max(share(d, b, 5) if d else 0.0 for b in ("the quick brown fox", "The exact item")) if d else 0.0
        assert got[i]["contamination_score"] == round(want, 4)
        assert got[i]["contaminated"] == (round(want, 4) >= 0.6)
    empty = contamination.flag_contaminated(records(spark, docs), bench.limit(0))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(docs)


def test_reports_are_additive(spark):
    rows = spark.createDataFrame([("a", "xy"), ("b", None), (None, "é"), ("a", "")], "source string, text string")
    whole = {tuple(r) for r in report.corpus_report(rows).collect()}
    parts = report.merge_reports(report.corpus_report(rows.limit(0)), report.corpus_report(rows.where("source = 'a'")), report.corpus_report(rows.where("source is null or source <> 'a'")))
    assert {tuple(r) for r in parts.collect() if r["records"]} == whole


def test_tail_split(spark):
    rows = spark.createDataFrame([(f"{i:03d}", "en" if i % 3 else "ja", None if i % 5 else "s", f"t{i}") for i in range(40)] + [("x", "fr", "one", "t")], "id string, language string, source string, text string")
    got = splits.tail_split(rows, 0.25).collect()
    groups = Counter((r["language"], r["source"] or r["language"]) for r in got)
    for g, n in groups.items():
        own = sorted((r for r in got if (r["language"], r["source"] or r["language"]) == g), key=lambda r: r["id"])
        cut = n if n < 2 else max(1, min(n - 1, int(n * (1 - 0.25))))
        assert [r["is_eval"] for r in own] == [False] * cut + [True] * (n - cut)


def plain_budget(parts, most):
    kept = []
    for lang in sorted({p[0] for p in parts}):
        used, stopped = 0, set()
        for source in sorted({p[1] for p in parts if p[0] == lang}):
            if used >= most:
                break
            for p in sorted(x for x in parts if x[:2] == (lang, source)):
                if used + p[3] > most:
                    break
                kept.append(p)
                used += p[3]
        del stopped
    return kept


def test_byte_budget(spark):
    rng = random.Random(3)
    parts = [(lang, s, i, rng.randint(1, 60)) for lang in ("en", "ja") for s in range(4) for i in range(rng.randint(0, 6))]
    rows = spark.createDataFrame(parts, "language string, ord long, idx long, bytes long")
    for most in (1, 100, 200, 10_000):
        assert sorted(tuple(r) for r in splits.byte_budget(rows, most).select("language", "ord", "idx", "bytes").collect()) == sorted(plain_budget(parts, most))


def test_load_order(spark):
    rows = records(spark, [f"t{i}" for i in range(50)])
    full = [r["id"] for r in splits.load_order(rows, 3).orderBy("ord").collect()]
    assert sorted(full) == sorted(f"r{i}" for i in range(50)) and full != [f"r{i}" for i in range(50)]
    assert [r["id"] for r in splits.load_order(rows, 3, 20, 10).orderBy("ord").collect()] == full[20:30]
    buffered = [r["id"] for r in splits.buffered_load_order(rows, 3, 8).orderBy("ord").collect()]
    assert buffered == [f"r{i}" for i in splits.buffer_order(50, 3, 8)] and sorted(buffered) == sorted(full)
    assert splits.buffer_order(50, 3, 1) == list(range(50))
    with pytest.raises(ValueError):
        splits.load_order(rows, 3, -1)


def plain_model(texts, order):
    counts = Counter()
    for t in texts:
        b = t.encode()
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                counts[k, b[i - k : i], b[i]] += 1
    return counts


def plain_bits(counts, order, text):
    totals = Counter()
    for (k, c, _), n in counts.items():
        totals[k, c] += n
    b, bits = text.encode(), 0.0
    for i in range(len(b)):
        num, z = 0.1 / 256, 0.1
        for k in range(min(order, i) + 1):
            c = b[i - k : i]
            if totals[k, c]:
                num += 4.0**k * counts[k, c, b[i]] / totals[k, c]
                z += 4.0**k
        bits -= math.log2(num / z)
    return bits, len(b)


def test_ngram_model(spark):
    train, held = ["hello world", "help the héllo", "", None], [("en", "hello held"), ("ja", "漢字"), ("ja", "")]
    rows = spark.createDataFrame([(t,) for t in train], "text string")
    counts = ngram.ngram_counts(rows, 3)
    got = {(r["k"], r["context"].to_bytes(r["k"], "big"), r["byte"]): r["n"] for r in counts.collect()}
    want = plain_model([t for t in train if t], 3)
    assert got == want
    for order in (0, 2, 3):
        result = {(r["language"], r["total"]): (r["bits"], r["bytes"]) for r in ngram.bits_per_byte(counts, spark.createDataFrame(held, "language string, text string"), order).collect()}
        for lang in ("en", "ja"):
            bits = [plain_bits(want, order, t) for x, t in held if x == lang]
            assert result[lang, False][1] == sum(b for _, b in bits) and abs(result[lang, False][0] - sum(b for b, _ in bits)) < 1e-9
    p = [r["p"] for r in ngram.next_byte_distribution(counts, b"hel", 3).collect()]
    assert len(p) == 256 and abs(sum(p) - 1) < 1e-9 and min(p) > 0


def plain_encode(merges, first, data):
    rank = {p: k for k, p in reversed(list(enumerate(merges)))}
    s = list(data)
    while True:
        best = min((rank[p] for p in zip(s, s[1:]) if p in rank), default=None)
        if best is None:
            return s
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and (s[i], s[i + 1]) == merges[best]:
                out.append(first + best)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out


def test_bpe_round_trip_and_reference():
    texts = random_texts(5, 120)
    model = BpeModel.train(Counter(t.encode() for t in texts).items(), 400)
    for t in [*texts, "aaaa" * 30, " ".join(texts)]:
        ids = model.encode(t)
        assert model.decode(ids) == t
        assert ids == plain_encode(model.merges, model.first, t.encode()) == model.encode_bytes(t.encode())
    assert model.counts(texts) == [len(model.encode(t)) for t in texts]
    with pytest.raises(ValueError):
        model.decode([999_999])
    with pytest.raises(ValueError):
        BpeModel.train([], 100)
    assert BpeModel.from_dict(model.to_dict()).merges == model.merges
    assert model.special_id("<eos>") == 257 and SPECIAL_TOKENS[1] == "<eos>"


def test_distributed_training_agrees(spark):
    texts = ["aaab abab", "aaab", "xyz aab", ""]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string")
    near = tokenizer.train_bpe(rows, 272)
    far = tokenizer.train_bpe_distributed(rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("w")), 272, every=3)
    assert near.merges == far.merges


def test_candidates_are_prefixes():
    model = BpeModel.train([(b"abcabcabd", 3)], 300)
    found = tokenizer.candidates(model, [264, 266, 290, 300])
    assert [c["merges"] for c in found] == [0, 2, len(model.merges)] and found[-1]["requested_vocab_sizes"] == [290, 300] and found[-1]["collapsed"]


CASES = [
    ("exact_match", " 144 ", "144", True), ("exact_match", "A", "a", False), ("normalized_match", "Ｈello, World!", "hello world", True), ("includes", "It is New-York.", "new york", True),
    ("includes", "x", "!", False), ("numeric_match", "The answer is 1,440.0 km", "1440", True), ("numeric_match", "none", "1", False), ("multiple_choice", "c", "C", True),
    ("multiple_choice", "The answer is (b).", "B", True), ("multiple_choice", "I choose (D) now", "d", True), ("multiple_choice", "A quick brown fox", "A", False), ("exact_match", None, "x", False),
]


def test_metrics(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, metric string, p string, t string, want boolean")
    got = [r[0] for r in rows.orderBy("i").select(score(F.col("metric"), F.col("p"), F.col("t"))).collect()]
    assert got == [c[3] for c in CASES]
    with pytest.raises(Exception, match="unknown metric"):
        spark.createDataFrame([("x", "a", "a")], "m string, p string, t string").select(score(F.col("m"), F.col("p"), F.col("t"))).collect()


def test_suites_and_grid(spark):
    tasks = spark.createDataFrame([("1", "a", "en", "What?", "144", "numeric_match", None), ("2", "b", "ja", "Which?", "B", "multiple_choice", ["A", "B"])], "id string, area string, language string, prompt string, answer string, metric string, choices array<string>")
    for name, passed in (("gold", 2), ("empty", 0)):
        overall = suite.accuracy(suite.run_suite(tasks, name)).where("level = 'overall'").first()
        assert (overall["passed"], overall["total"]) == (passed, 2)
    grid = suite.haystack_tasks(spark, [50, 20, 50], [1.0, 0.0])
    assert grid.count() == 4
    for r in grid.collect():
        key, value = suite.needle([(20, 0.0), (20, 1.0), (50, 0.0), (50, 1.0)].index((r["length"], r["depth"])))
        assert r["answer"] == value and r["prompt"][r["needle_pos"] :].startswith(f"Note: the secret {key}")
    assert suite.haystack_scores(grid, "gold").agg(F.min("passed")).first()[0] == 1


def test_index_and_chat(spark):
    probes = spark.createDataFrame([("p", 0, "same text"), ("q", 1, "  ")], "id string, pos long, text string")
    tasks = spark.createDataFrame([("t", 0, "same text\n", "long answer"), ("u", 1, "other", "no")], "id string, pos long, prompt string, answer string")
    assert sorted(r["id"] for r in index.benchmark_index(probes, tasks).collect()) == ["probes:p", "smoke-scored:t:answer", "smoke-scored:u:prompt"]
    chat = spark.createDataFrame([(1, 1, "user", "hi"), (1, 0, "system", "be"), (1, 2, "assistant", None)], "conv_id long, turn int, role string, content string")
    assert tokenizer.format_chat(chat).first()["text"] == "<bos><system>be<eos><user>hi<eos><assistant><eos>"
    with pytest.raises(Exception, match="unknown role"):
        tokenizer.format_chat(spark.createDataFrame([(1, 0, "tool", "x")], "conv_id long, turn int, role string, content string")).collect()


def test_vocab_choice(spark):
    def pick(rows):
        table = spark.createDataFrame(rows, "name string, effective_vocab_size long, collapsed boolean, candidate_ja double, beats_byte_baseline boolean")
        return [tuple(r) for r in tokenizer.choose_vocab(table).collect()]

    assert pick([("a", 1, False, 2.0, True), ("b", 2, False, 1.5, True), ("c", 4, False, 1.45, True)]) == [("b", True)]
    assert pick([("a", 1, False, 2.0, True), ("b", 2, False, 1.0, True)]) == [("b", False)]
    assert pick([("a", 1, True, 2.0, True), ("b", 2, False, 4.0, False)]) == []


def test_governance(tmp_path):
    good = {"name": "n", "version": "1", "source": "s", "license": "l", "license_review": "compatible", "use": "evaluation", "languages": ["en"], "domains": ["d"], "estimated_tokens": 1, "retrieval_script": "r",
            "processing_config": "c", "filters": ["f"], "status": "candidate", "pii_policy": {"required": True, "method": "m", "status": "planned"}, "contamination_check": {"required": False, "method": "m", "status": "complete"}}
    assert governance.manifest_violations(good | {"unknown": 1}) == []
    for change in ({"use": "x"}, {"languages": ["EN"]}, {"languages": []}, {"estimated_tokens": -1}, {"reviewed_at": "2020"}, {"pii_policy": {}}):
        assert governance.manifest_violations(good | change)
    meta = {k: "x" for k in governance.CHECKPOINT} | {"architecture": {}, "training_token_count": 0, "intended_status": "candidate"}
    assert governance.checkpoint_violations(meta) == []
    assert governance.checkpoint_violations(meta | {"training_token_count": True}) and governance.checkpoint_violations(meta | {"more": 1})
    assert governance.config_hash({"b": 1, "a": 2}) == governance.config_hash({"a": 2, "b": 1})
    assert governance.config_violations({"eval_id": "e", "version": "1", "model": {"id": "m"}, "tasks": [{"id": "a", "area": "a", "type": "t", "prompt": "p", "expected_behavior": "x"}]}) == []


def test_pipeline(spark):
    texts = ["An English sentence about a lamp.", "An English sentence about a lamp.", "An English sentence, about a lamp!", " ", "", "ab", "日本語の文です。", "the benchmark item text"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string")
    bench = spark.createDataFrame([("b", "the benchmark item text")], "id string, text string")
    run = Pipeline(near_threshold=0.6, limits=ingest.QualityLimits(min_chars=3))
    assert [r["pos"] for r in run.records(rows, bench).orderBy("pos").collect()] == [0, 6]
    total = run.report(rows, bench).where("total").first()
    assert total["records"] == 2 and total["chars"] == len(texts[0]) + len(texts[6])


def test_helper_columns_dont_clash(spark):
    rows = spark.createDataFrame([("a", 0, "t one", "s", "x"), ("b", 1, "t one", "s", "y"), ("c", 2, "t two", "s", "z")], "id string, pos long, text string, source string, _h string")
    odd = rows.withColumns({n: F.lit(7) for n in ("_k", "_found", "_same", "_score", "_rank", "_place", "ord", "Language")})
    assert {r["_h"] for r in dedup.exact_dedup(odd).collect()} == {"x", "z"}
    bench = spark.createDataFrame([("t one",)], "text string")
    for joined in (False, True):
        flagged = contamination.flag_contaminated(odd, bench, joined=joined)
        assert {r["id"]: (r["contaminated"], r["_same"], r["_h"]) for r in flagged.collect()}["a"] == (True, 7, "x")
    assert dedup.first_per_key(odd, ["text"], ["pos"]).columns == odd.columns
    assert splits.load_order(odd.drop("ord"), 1).columns == [*odd.drop("ord").columns, "ord"]


def test_very_long_texts(spark):
    long = "word " * 40_000 + " " * 200_000 + "end"
    rows = spark.createDataFrame([("a", 0, long, "s"), ("b", 1, long + "!", "s"), ("c", 2, "x" * 300_000, "s")], "id string, pos long, text string, source string")
    assert ingest.ingest(rows, "s").count() == 3
    assert [r["pos"] for r in dedup.near_dedup(rows, 0.8, 5).orderBy("pos").collect()] == [0, 2]
    assert ingest.quality_ratios(rows, "id").agg(F.sum("chars")).first()[0] == 2 * len(long) + 1 + 300_000
