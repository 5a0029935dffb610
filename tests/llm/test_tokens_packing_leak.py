"""Token budget, packing and leaked items."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from quillmill.functions.bpe import BpeModel
from quillmill.llm import leak, packing, tokens
from quillmill.llm.fmindex import FMIndex, suffix_order

MODEL = BpeModel.train(Counter({b"the cat sat on the mat and the dog": 3, "猫が庭で".encode(): 2}).items(), 300)


def test_pieces_add_up():
    rng = random.Random(2)
    joined = MODEL.joined_pairs()
    for _ in range(60):
        text = "".join(rng.choice(["the ", "cat", "Z", "!", "猫が", "庭で", "\n", "Q"]) for _ in range(rng.randint(0, 300)))
        for size in (1, 20, 1000):
            parts = tokens.independent_pieces(text, joined, size)
            assert "".join(parts) == text and sum(map(MODEL.token_count, parts)) == MODEL.token_count(text)


def test_token_counts(spark):
    old, tokens.LARGE = tokens.LARGE, 40
    try:
        texts = {"a": "the cat", "b": "the dog! " * 40, "c": "", "d": None, "e": "猫が庭で" * 9}
        rows = spark.createDataFrame(list(texts.items()), "id string, text string")
        got = {r["id"]: r["tokens"] for r in tokens.token_counts(rows, "id", MODEL).collect()}
        assert got == {i: MODEL.token_count(t or "") for i, t in texts.items()}
    finally:
        tokens.LARGE = old


def test_totals(spark):
    merges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(MODEL.merges)], "merge_rank int, left_id int, right_id int")
    meta = {"language": " EN", "domain": "WEB"}
    records = spark.createDataFrame([("r1", "the cat", "A Source", meta), ("r1", "the cat", "A Source", meta), ("r2", "the dog", "a_source", None), ("r3", None, None, {"language": "und"})], "id string, text string, source string, meta map<string,string>")
    probes = spark.createDataFrame([("p1", "mat", "en", "english prose"), ("p2", "dog", "En ", "ENGLISH_PROSE")], "id string, text string, language string, domain string")
    sources = spark.createDataFrame([("a-source", "fr", "Reports"), ("a-source", "fr", "reports"), (None, None, None)], "source string, language string, domain string")
    rows = tokens.row_tokens(records, probes, sources, merges)
    got = {r["id"]: (r["source"], r["language"], r["domain"], r["tokens"]) for r in rows.collect()}
    n = MODEL.token_count
    assert got == {"r1": ("a_source", "en", "web", n("the cat")), "r2": ("a_source", "fr", "reports", n("the dog")), "r3": (None, None, None, 0), "p1": (None, "en", "english_prose", n("mat")), "p2": (None, "en", "english_prose", n("dog"))}
    totals = {(r["origin"], r["slice"], r["source"] or r["language"] or r["domain"]): (r["rows"], r["tokens"]) for r in tokens.token_totals(rows).collect() if r["slice"] in ("all", "source", "domain")}
    assert totals["records", "all", None] == (3, n("the cat") + n("the dog")) and totals["records", "source", "a_source"] == (2, n("the cat") + n("the dog"))
    assert totals["probes", "domain", "english_prose"] == (2, n("mat") + n("dog"))


def test_best_two_fit():
    rng = random.Random(1)
    for _ in range(80):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
        bins = packing.best_two_fit(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= 11 / 9 * -(-sum(sizes) // capacity) * 1.7 + 2
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 4, 5], 10))) == [[0, 3], [1, 2, 4]]


def test_packing(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 5, 30, 99, 100, 101, 250, 300]) for i in range(200)}
    sized = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    windows = spark.createDataFrame([("small", 100), ("big", 1000), ("small", 100), (None, None)], "window_name string, capacity_tokens int")
    rows = packing.pack(sized, windows).collect()
    for name, capacity in (("small", 100), ("big", 1000)):
        own = [r for r in rows if r["window_name"] == name]
        fill, parts = Counter(), {}
        for r in own:
            fill[r["container_id"]] += r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        assert max(fill.values()) <= capacity and set(parts) == set(sizes)
        for d, p in parts.items():
            p.sort()
            assert sum(x[2] for x in p) == sizes[d] and (len(p) == 1 or sizes[d] > capacity)
            assert [x[1] for x in p] == [sum(y[2] for y in p[:k]) for k in range(len(p))]
        assert sum(fill.values()) >= 0.9 * capacity * sum(v > 0 for v in fill.values())
    report = {r["window_name"]: r for r in packing.fill_report(packing.pack(sized, windows), windows).collect()}
    assert report["small"]["documents"] == 200 and report["small"]["unused_tokens"] >= 0
    assert packing.pack(sized.limit(0), windows).count() == 0


def test_fm_index():
    rng = random.Random(5)
    for _ in range(60):
        k = rng.randint(2, 7)
        s = np.array([rng.randint(1, k - 1) for _ in range(rng.randint(1, 80))])
        z = np.concatenate([s, [0]])
        assert list(suffix_order(z, k)) == sorted(range(len(z)), key=lambda i: list(z[i:]))
        index = FMIndex(s, k, step=rng.randint(1, 9))
        patterns = np.array([[rng.randint(1, k - 1) for _ in range(3)] for _ in range(12)])
        lengths = np.array([rng.randint(1, 3) for _ in range(12)])
        lo, hi = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            got = sorted(index.locate(np.arange(a, b))) if b > a else []
            assert got == [i for i in range(len(s) - n + 1) if list(s[i : i + n]) == list(p[:n])]


def test_leaked(spark, rng, sentence):
    items = [(f"i{k}", "Think step by step. " + " ".join(sentence(12) for _ in range(3)) + " How many remain?", None) for k in range(8)]
    items.append(("ja", "記号で答えてください。机の上に赤い本が三冊あり、その横に青い箱が置かれていました。最後に残るものは何ですか。", None))
    body = [t.split(". ", 1)[1] for _, t, _ in items[:8]]
    half = body[2].split()
    changed = body[3].split()
    changed[4], changed[13] = "zebra", "quartz"
    docs = [
        sentence(20) + " " + items[0][1] + " " + sentence(20), "x " + body[1].upper().replace(".", " ;") + " y", " ".join(half[: int(len(half) * 0.75)]), " ".join(changed),
        "Think step by step. " + sentence(30) + " How many remain?", " ".join(half[:8]), sentence(60), "前文です。机の上に赤い本が三冊あり、\nその横に青い箱が置かれていました。", "", None,
        "Ｔhink " + body[4].replace("a", "а"),
    ]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, ("null", None, None), ("blank", " ", None)], "id string, text string, source string")
    got = sorted(tuple(r) for r in leak.leaked(table, bench).collect())
    assert got == sorted([(0, "i0"), (1, "i1"), (2, "i2"), (3, "i3"), (7, "ja"), (10, "i4")])
    assert leak.leaked(table, bench.limit(0)).count() == 0 and leak.leaked(table.limit(0), bench).count() == 0
    old, leak.BLOCK = leak.BLOCK, 3
    try:
        assert sorted(tuple(r) for r in leak.leaked(table, bench).collect()) == got
    finally:
        leak.BLOCK = old


def test_runs_and_chains_against_brute_force(rng):
    for _ in range(80):
        left, right = ([rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        found = leak.runs(left, right, 2)
        want = {
            (i, j, n) for i in range(len(left)) for j in range(len(right)) for n in range(2, 15)
            if left[i : i + n] == right[j : j + n] and i + n <= len(left) and j + n <= len(right)
            and not (i and j and left[i - 1] == right[j - 1]) and (i + n == len(left) or j + n == len(right) or left[i + n] != right[j + n])
        }
        assert set(found) == want and len(found) == len(want)

        def weight(at, to):
            return max([n + weight(i + n, j + n) for i, j, n in found if i >= at and j >= to], default=0)

        chain = leak.chained(found)
        assert sum(n for _, _, n in chain) == weight(0, 0)
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(chain, chain[1:]))


def test_blocks_share_their_instructions_and_spans_merge(spark, monkeypatch):
    words = "lamp harbour window letter river table garden winter market bridge paper engine silver morning valley stone".split()
    items = [(f"i{k}", f"Answer the question in one short line please. {words[k]} {words[k + 1]} {words[k + 5]} {words[k + 7]} stands near {words[k + 3]} today") for k in range(8)]
    docs = [(1, "Before. " + items[2][1] + " After."), (2, "Answer the question in one short line please."), (3, items[0][1] + " " + items[0][1] + " and " + items[5][1]), (4, None), (5, " ")]
    documents, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, ("null", None), ("blank", " ")], "id string, text string")
    for block in (leak.BLOCK, 3):
        monkeypatch.setattr(leak, "BLOCK", block)
        assert {tuple(r) for r in leak.leaked(documents, table).collect()} == {(1, "i2"), (3, "i0"), (3, "i5")}
    spans = [tuple(r) for r in leak.removal_spans(documents, table).orderBy("doc_id", "first").collect()]
    assert [s[0] for s in spans] == [1, 3, 3, 3] and docs[0][1][spans[0][1] : spans[0][2]].startswith("Answer the") and spans[-1][3] == ["i5"]
