"""Prose, language and spam operators on hand-made texts."""

from __future__ import annotations

import numpy as np

from quillmill.llm import langid, quality, stuffing
from quillmill.llm.boosting import BoostedTrees
from quillmill.llm.checked import holdout, seeds
from quillmill.llm.sentences import spans

PROSE = {
    "en": ["The old bridge was closed in winter because the river had frozen. Nobody could cross it with a cart.", "She wrote to her brother about the garden, and he answered that it was not his."],
    "fr": ["Le vieux pont était fermé en hiver parce que la rivière était gelée. Personne ne pouvait passer avec une charrette.", "Elle a écrit à son frère pour le jardin, et il a répondu que ce n'était pas le sien."],
    "de": ["Die alte Brücke war im Winter geschlossen, weil der Fluss gefroren war. Niemand konnte sie mit einem Wagen überqueren.", "Sie schrieb ihrem Bruder über den Garten, und er antwortete, dass es nicht seiner sei."],
    "es": ["El viejo puente estaba cerrado en invierno porque el río se había helado. Nadie podía cruzarlo con un carro.", "Ella escribió a su hermano sobre el jardín, y él contestó que no era suyo."],
    "ja": ["冬になると川が凍ったので、古い橋は閉まっていました。誰も車で渡ることができませんでした。", "彼女は庭について兄に手紙を書きましたが、兄は自分のものではないと答えました。"],
}
JUNK = ["red lamp\nold chair, table\nblue box\nsmall window", "a | b | c\n1 | 2 | 3", "x = 1\ny = foo(x)\nreturn y", "赤い箱。\n古い橋。\n小さな窓、椅子。"]


def test_sentences():
    for texts in PROSE.values():
        for t in texts:
            assert sum(b - a for a, b, _ in spans(t)) > 0.9 * len(t)
    for t in JUNK:
        assert sum(b - a for a, b, _ in spans(t)) < 0.35 * len(t)
    assert spans("") == [] and len(spans("It was late and the road was\nlong. — I know, said the man to her.")) == 2


def test_boosting_learns(rng):
    x = np.array([[rng.random(), rng.random()] for _ in range(600)])
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)
    model = BoostedTrees().fit(x, y).calibrate(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


def _labelled(spark):
    rows = [(f"{lang}{i}-{k}", f"{t} {u}", lang if k % 9 else None) for lang, texts in PROSE.items() for k in range(24) for i, (t, u) in enumerate([texts, texts[::-1]])]
    return rows


def test_not_prose(spark):
    prose = [(i, t, None) for i, t, _ in _labelled(spark)]
    junk = [(f"junk{k}", t, None) for k, t in enumerate(JUNK * 12)]
    rows = spark.createDataFrame([*prose, *junk, junk[0], ("null", None, None), ("blank", " \n", None)], "id string, text string, prose string")
    got = [r["id"] for r in quality.not_prose(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == {j[0] for j in junk}
    stats = {r["id"]: r for r in quality.statistics(rows).collect()}
    assert stats["null"]["words"] is None and stats["blank"]["chars"] == 0 and stats["en0-0"]["sentence_share"] > 0.9


def test_calibration_on_texts_never_trained_on(spark):
    held = holdout()
    assert len(held) >= 200 and not {t for t, _ in held} & {t for t, _ in seeds()}
    rows = spark.createDataFrame(_labelled(spark), "id string, text string, language string")
    for few in (rows, rows.limit(0)):
        wrong, error = quality.calibration_error(quality.train(few))
        print(f"holdout: {wrong:.4f} wrong, calibration error {error:.4f}")
        assert wrong <= 0.02 and error <= 0.05


def test_weak_labels_do_not_read_sentences():
    code = 'def a(b):\n    """The door was left open by the men of the town."""\n    return b\n' * 3
    assert quality.weak_label(code, "python_code") == 0
    assert quality.weak_label(PROSE["en"][0], "english_prose") == 1
    assert quality.weak_label(PROSE["en"][0], None) is None and quality.weak_label("", "web") is None
    assert quality.weak_label(JUNK[0], "english_prose") == 0


def test_language_of_code_and_of_few_sentences(spark):
    code = 'def a(b):\n    """The door was left open by the men of the town."""\n    c = b + 1\n    if c > 12:\n        raise ValueError(c)\n    return c\n'
    listed = PROSE["en"][0] + "\n" + "\n".join(f"- garden chair {k}" for k in range(60))
    table = spark.createDataFrame([*_labelled(spark), ("code-", code, None), ("list-", listed, "de")], "id string, text string, label string")
    got = {r["id"]: r["languages"] for r in langid.documents(table).collect()}
    assert got["code-"] == [] and got["list-"] == ["en"]
    assert {r["id"] for r in langid.segments(table).where("id in ('code-', 'list-')").collect()} == {"list-"}


def test_languages(spark):
    rows = _labelled(spark)
    mixed = [("mix1", PROSE["en"][0] + " " + PROSE["de"][0], "en"), ("mix2", PROSE["ja"][0] + PROSE["fr"][1], "ja-fr")]
    cases = [("wrong", PROSE["es"][0], "fr"), ("blank", PROSE["fr"][0], " "), ("word", PROSE["de"][0], "unknown"), ("case", PROSE["en"][1], " EN "), ("name", "The shop in Rue de la Paix was open, and we bought a croissant in it.", "en")]
    other = [("list", JUNK[0], None), ("null", None, None), ("empty", "", "en")]
    table = spark.createDataFrame([*rows, *mixed, *cases, *other, cases[0]], "id string, text string, label string")
    got = sorted(tuple(r) for r in langid.mislabelled(table).where("not id like '%-%'").collect())
    assert got == sorted([("mix1", "en"), ("mix1", "de"), ("mix2", "ja"), ("mix2", "fr"), ("wrong", "es"), ("blank", "fr"), ("word", "de")])
    unlabelled = {r[0] for r in rows if r[2] is None}
    assert {r["id"] for r in langid.mislabelled(table).collect() if "-" in r["id"]} == unlabelled
    parts = langid.segments(table).where("id = 'mix1'").orderBy("segment").collect()
    assert [p["language"] for p in parts] == ["en", "de"] and all(p["confidence"] > 0 for p in parts)
    assert langid.documents(table.limit(0)).count() == 0


def _spam(rng):
    keys = ["cheap lamps", "best garden chair", "silver lamp shop"]
    yield " | ".join(rng.choice(keys) + rng.choice(["", " sale", " online"]) for _ in range(60))
    yield " ".join(f"#{rng.choice(['lamp', 'chair', 'garden', 'sale'])}" for _ in range(50))
    yield "\n".join(f"https://shop{k}.example/page{k}.html" for k in range(30))
    yield "\n".join(f'<a href="http://site{k}.test/x">link word{k}</a>' for k in range(30))
    yield "ランプ通販 | " * 10 + " | ".join(rng.choice(["銀のランプ格安", "銀のランプ", "庭椅子人気", "庭椅子"]) for _ in range(60))


def test_stuffed_pages(spark, rng, sentence):
    spam = list(_spam(rng))
    article = " ".join(sentence(11) for _ in range(20))
    fine = [article, article + "\n[1] https://a.example/one.html\n[2] https://b.example/two.html", *JUNK, "\n".join(f"word{k}: meaning{k * 7} of thing{k * 3}" for k in range(30)), "", *[t for v in PROSE.values() for t in v]]
    fine.append("def area(width, height):\n    total = width * height\n    return total\n" * 6)
    fine.append(article + " " + spam[0][:150])
    rows = [(k, t, "x") for k, t in enumerate([*spam, article + "\n" + spam[0] * 4, *fine, None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, form string")
    assert sorted(r["doc_id"] for r in stuffing.stuffed_pages(table).collect()) == list(range(len(spam) + 1))
    assert stuffing.stuffed_pages(table.limit(0)).count() == 0


def test_suffix_automaton(rng):
    for _ in range(60):
        units = [rng.choice("ab") for _ in range(rng.randint(1, 25))]
        machine = stuffing.SuffixAutomaton(units)
        text = "".join(units)
        for times in (2, 3):
            far = machine.repeated_suffixes(units, times)
            for i in range(len(text)):
                want = max((n for n in range(1, i + 2) if sum(text.startswith(text[i + 1 - n : i + 1], k) for k in range(len(text))) >= times), default=0)
                assert far[i] == want


def test_long_runs_stay_linear():
    import time

    from quillmill.llm.visual import consistent_form

    began = time.time()
    for text in ("a" * 300_000, " " * 300_000 + "x", "." * 300_000 + "x", "a." * 150_000, "「" * 100_000, "\n" * 300_000 + "x", "# " * 150_000, "ab-" * 100_000, "[" * 100_000, "http://" * 40_000, "a " * 150_000, "漢" * 200_000):
        form = consistent_form(text)
        spans(form)
        stuffing.is_stuffed(form)
        quality.features([form])
    assert time.time() - began < 60


def _invented(rng, n: int) -> list[str]:
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(n)]


def test_many_keywords_are_stuffing(rng, monkeypatch):
    keys = _invented(rng, 150)
    assert stuffing.is_stuffed(", ".join(keys[:100] * 8))
    rotated = keys * 30
    rng.shuffle(rotated)
    assert stuffing.is_stuffed(", ".join(rotated))
    assert not stuffing.is_stuffed("\n".join(_invented(rng, 900)))
    monkeypatch.setattr(stuffing, "AT_ONCE", 100)
    assert stuffing.is_stuffed(", ".join(keys[:120] * 8))


def test_links_with_natural_titles_are_stuffing(rng):
    lines = [f"[The best of the {rng.choice(['garden', 'river', 'market', 'bridge'])} in {a} and {b}](/p{k})" for k, (a, b) in enumerate(zip(_invented(rng, 40), _invented(rng, 40)))]
    assert stuffing.is_stuffed("\n".join(lines))


def test_tag_lines_are_no_code(rng):
    assert stuffing.is_stuffed("\n".join(f"#cheap{rng.choice(['shoes', 'boots'])} #sale #{w}" for w in _invented(rng, 30)))
    assert stuffing.is_stuffed("\n".join(f"Tags: cheap shoes, cheap boots, cheap {w}" for w in _invented(rng, 30)))
    assert stuffing.is_stuffed("cheap shoes; cheap boots;\n" * 30)
    assert not stuffing.is_stuffed("#include <a.h>\nint total = sum(a, b);\nreturn total;\n" * 10)


def test_language_of_a_sentence_beside_a_list(spark):
    listed = "\n".join(f"- {w} {k}" for k, w in enumerate("lampe stuhl tisch brett kasten nagel".split() * 6))
    rows = [*_labelled(spark), ("listed", PROSE["de"][1] + "\n\n" + listed, None), ("only", listed, None)]
    table = spark.createDataFrame(rows, "id string, text string, label string")
    got = [tuple(r) for r in langid.mislabelled(table).where("id in ('listed', 'only')").collect()]
    assert got == [("listed", "de")]


def test_automaton_against_brute_force(rng):
    from quillmill.llm.automaton import BETWEEN, Automaton

    for width in (1, 3, 7):
        words = ["".join(rng.choice("abcé猫") for _ in range(width)) for _ in range(40)]
        text = "".join(rng.choice("abcé猫") for _ in range(3000))
        machine = Automaton(np.array([ord(c) for w in words for c in w], np.uint32), np.arange(len(words)) * width, width)
        code = {int(k): w for k, w in zip(machine.code, words)}
        points = np.array([ord(c) for c in text], np.uint32)
        points[1500] = BETWEEN
        place, found = machine.scan(points)
        want = sorted((k + width - 1, text[k : k + width]) for k in range(len(text) - width + 1) if text[k : k + width] in words and not k <= 1500 < k + width)
        assert sorted((int(p), code[int(c)]) for p, c in zip(place, found)) == want


def test_runs_of_frequent_units_give_the_same_repetitions(rng):
    from collections import Counter

    for _ in range(60):
        units = [rng.choice("abcdefghijklmnop"[: rng.randint(2, 16)]) for _ in range(rng.randint(1, 90))]
        seen = Counter(units)
        whole = stuffing.SuffixAutomaton(units).repeated_suffixes(units, 3)
        runs = [u if seen[u] >= 3 else None for u in units]
        assert stuffing.SuffixAutomaton(runs).repeated_suffixes(runs, 3) == whole
