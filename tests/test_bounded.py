"""Work that is done in bounded steps: the same results, and no step that holds all."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
import pytest

from quillmill.functions import shingles
from quillmill.functions.bpe import BpeModel
from quillmill.llm import overlap
from quillmill.operators import contamination, dedup, tokenizer


def brute_pairs(texts):
    return Counter(p for t in texts if t for p in zip(t.encode(), t.encode()[1:]))


def test_encoding_holds_a_step(monkeypatch):
    """The library never gets a whole batch at once, and the ids are the same."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcé ", k=400)) for _ in range(600)]
    model, held = BpeModel([(97, 98), (264, 99)]), []
    want = [model.encode_bytes(t.encode()) for t in texts]

    class Encoding:
        def __init__(self, ids):
            self.ids = ids

        def __len__(self):
            return len(self.ids)

    class Library:
        def encode_batch_fast(self, part, add_special_tokens):
            held.append(sum(map(len, part)))
            return [Encoding(model.encode_bytes(t.encode())) for t in part]

    monkeypatch.setattr(model, "_fast", Library())
    assert model.encode_batch(texts) == want and model.counts(texts) == [len(w) for w in want]
    assert sum(held) == 2 * sum(map(len, texts)) and max(held) <= shingles.STEP_CHARS


def test_pair_counts_in_steps(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "a", "aaa", *["".join(rng.choices("abcdé ", k=rng.randint(0, 90))) for _ in range(80)]]
    want = brute_pairs(texts)
    got = tokenizer.text_pair_counts(spark.createDataFrame([(t,) for t in texts], "text string"), BpeModel([])).collect()
    assert {(r["left_id"], r["right_id"]): r["n"] for r in got} == want
    monkeypatch.setattr(tokenizer, "STEP_IDS", 50)
    monkeypatch.setattr(tokenizer, "MOST_PAIRS", 20)
    seqs = [list((t or "").encode()) for t in texts]
    parts = list(tokenizer._adjacent(iter([(seqs[:40], pd.Series([2] * 40).to_numpy("int64")), (seqs[40:], pd.Series([1] * (len(seqs) - 40)).to_numpy("int64"))])))
    total = Counter()
    for part in parts:
        for r in part.itertuples():
            total[r.left_id, r.right_id] += r.n
    assert len(parts) > 2 and total == brute_pairs(texts[:40] * 2 + texts[40:])


def test_top_pair_of_texts(spark):
    """The pair that most texts have, found without a table of all ids."""
    texts = spark.createDataFrame([("ba ba",), ("abab",), (None,)], "text string")
    best = tokenizer.top_pair(tokenizer.text_pair_counts(texts, BpeModel([])))
    assert [tuple(r) for r in best.collect()] == [(98, 97, 3)]


def test_large_benchmark_sets_are_sharded(spark, monkeypatch):
    """Scores over several shards are those of one set, and no n-gram of a document is a row of the plan."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [text(rng.randint(3, 20)) for _ in range(50)]
    docs = [None, "", *items[:5], *[rng.choice(items) + " " + text(rng.randint(0, 30)) for _ in range(40)]]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    bench = spark.createDataFrame([(t,) for t in items], "text string")
    monkeypatch.setattr(contamination, "SHARD_GRAMS", 1000)
    one, several = (contamination.flag_contaminated(rows, bench, "id", 0.3, 5, joined) for joined in (False, True))
    want = {r["id"]: (r["contaminated"], r["contamination_score"]) for r in one.collect()}
    assert {r["id"]: (r["contaminated"], r["contamination_score"]) for r in several.collect()} == want
    assert {s for f, s in want.values()} >= {0.0, 1.0} and len({s for _, s in want.values()}) > 10
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_common_grams_are_counted_in_steps(monkeypatch):
    rng = random.Random(6)
    items = ["the same instruction for all of them " + "".join(rng.choices("abcd", k=9)) for _ in range(90)]
    docs = [rng.choice(items) + "".join(rng.choices("abcd", k=40)) for _ in range(30)] + ["", "nothing"]
    held = contamination._Profiles(items, 5)
    want = held.best(docs, 5)
    grams = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    assert [round(x, 9) for x in want] == [round(max(len(grams(d) & grams(t)) / len(grams(d) | grams(t)) for t in items), 9) for d in docs]
    for most in (100, 5000):
        monkeypatch.setattr(contamination, "STEP_COMMON", most)
        assert (held.best(docs, 5) == want).all()


def test_training_takes_few_bytes_a_byte(monkeypatch):
    """Training over a megabyte holds less than 30 bytes for each of its bytes, and steps change no merge."""
    import tracemalloc

    from quillmill.functions import bpe

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgé ", k=6)) for _ in range(200)]
    texts = [(" ".join(rng.choices(words, k=80)).encode(), rng.randint(1, 3)) for _ in range(1700)]
    size = sum(len(t) for t, _ in texts)
    monkeypatch.setattr(bpe, "STEP_IDS", 100_000)
    tracemalloc.start()
    model = BpeModel.train(iter(texts), 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 900_000 and peak < 30 * size
    for most in (1000, 3 * size):
        monkeypatch.setattr(bpe, "STEP_IDS", most)
        assert BpeModel.train(texts, 300).merges == model.merges


def test_candidates_of_large_training(spark):
    """Candidates from texts with runs of one byte, empty texts and an id of more than two bytes."""
    texts = [b"aaaaaaa", b"aaa", b"", b"abab", "éé".encode()]
    small = BpeModel.train([(t, 2) for t in texts], 280)
    assert BpeModel.train([(t, 2) for t in texts], 70_000).merges[: len(small.merges)] == small.merges
    assert small.merges[0] == (97, 97) and small.merges[1][0] in (97, 264)
    found = tokenizer.candidates(small, [264, 265, 280])
    assert [c["merges"] for c in found] == [0, 1, len(small.merges)]
    trained = tokenizer.train_bpe(spark.createDataFrame([(t.decode(),) for t in texts * 2], "text string"), 280)
    assert trained.merges == small.merges


@pytest.mark.parametrize("threshold,n", [(0.3, 2), (0.6, 5), (0.8, 5), (1.0, 1)])
def test_similar_pairs_of_shards(spark, monkeypatch, threshold, n):
    """All pairs with their counts, over many small shards, some of them of one size; no n-gram is a row of a join."""
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefg ", k=k)) for k in (1, 3, 5, 9, 20, 40, 60, 60, 150, 400)]
    texts = set()
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.choice([1, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice("abcdefgxyz")
            texts.add("".join(t[: rng.randint(max(1, len(t) * 3 // 4), len(t))]))
    texts = sorted(texts)
    rng.shuffle(texts)
    grams = [{t[k : k + n] for k in range(max(1, len(t) - n + 1))} for t in texts]
    want = {(a, b, len(x & y), len(x | y)) for b, y in enumerate(grams) for a, x in enumerate(grams[:b]) if len(x & y) / len(x | y) >= threshold}
    monkeypatch.setattr(dedup, "LEAST_CHARS", 400)
    found = dedup.similar_pairs(spark.createDataFrame(list(enumerate([*texts, ""])), "pos long, text string"), threshold, n)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_no_texts_give_no_pairs(spark):
    for rows in ([], [(0, "")]):
        assert dedup.near_dedup(spark.createDataFrame(rows, "pos long, text string")).count() == len(rows)


def test_every_coverage_counts(spark):
    """Half of a test record in a long training text, a short training text inside one, and the record's own id in both splits."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip().replace("  ", " x")
    half, inside, own = text(1400), text(1400), text(1400)
    rows = [("a", half, "half", "test"), ("b", text(5000) + half[:700] + text(5000), "s", "train"), ("c", inside, "inside", "test"), ("d", inside[200:480], "s", "train")]
    rows += [("e", own, "own", "test"), ("e", own, "own", "train"), ("f", own[:700] + text(900), "s", "train"), ("g", text(900), "none", "validation")]
    table = spark.createDataFrame(rows, "id string, text string, source string, split_name string")
    got = {r["source"]: r for r in overlap.overlap_report(table).collect()}
    assert {k: (r["contained"], r["pairs"]) for k, r in got.items()} == {k: (0, 0) for k in ("half", "inside", "own", "none")}
    assert 0.42 < got["half"]["mean_coverage"] < 0.58 and 0.12 < got["inside"]["mean_coverage"] < 0.28
    assert 0.42 < got["own"]["mean_coverage"] < 0.58 and got["none"]["mean_coverage"] == 0


def test_first_of_similar_texts_is_kept_over_shards(spark, monkeypatch):
    """A short text that comes later than a longer one in another shard is dropped, whatever their shards; the sizes are joined once."""
    rng = random.Random(10)
    base = "".join(rng.choices("abcdefghij", k=300))
    texts = [base[:250], *["".join(rng.choices("klmnopq", k=k)) for k in range(200, 320, 4)], base[:290], base[:240], base]
    monkeypatch.setattr(dedup, "LEAST_CHARS", 300)
    kept = [r["pos"] for r in dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "pos long, text string")).orderBy("pos").collect()]
    assert kept == list(range(31))
