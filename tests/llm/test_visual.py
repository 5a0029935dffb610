"""One consistent form and the pairs that look the same."""

from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import visual

SAME = [
    ("Hello", "Ｈｅｌｌｏ"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a︎b"), ("pace", "расе"), ("fix", "ﬁx"), ("a\nb", "a \r\nb"), ("a", "a  \n"),
    ("ガ", "ｶﾞ"), ("人", "⼈"), ("ä", "ӓ"), ("a-b", "a‑b"), ("x\ty", "x y"), ("データ", "デ一タ"), ("窓口", "窓ロ"), ("ミルカダル", "ミル力ダル"),
]
OTHER = [("Hello", "hello"), ("cafe", "café"), ("x2", "x²"), ("a.", "a!"), ("a1", "a2"), ("1", "①"), ("ab", "a b"), ("½", "1⁄2"), ("。", ".")]


def test_same_and_other():
    for a, b in SAME:
        assert visual.consistent_form(a) == visual.consistent_form(b), (a, b)
    for a, b in OTHER:
        assert visual.consistent_form(a) != visual.consistent_form(b), (a, b)
    assert visual.consistent_form(None) is None and visual.consistent_form(" 　\n") == ""
    assert visual.consistent_form("Straße", fold_case=True) == "strasse"


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_form_is_stable(text):
    form = visual.consistent_form(text)
    assert visual.consistent_form(form) == form
    assert visual.consistent_form(unicodedata.normalize("NFD", text)) == form


def test_pairs(spark):
    rows = [("a", "Some text"), ("b", "Ｓome text"), ("c", "Some text"), ("d", "some text"), ("a", "Some text"), ("e", None), ("f", " "), ("g", "　"), ("h", "Some text")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, form string")
    got = sorted(tuple(r) for r in visual.look_alikes(table).collect())
    assert got == [("a", "b"), ("a", "h"), ("b", "c"), ("b", "h"), ("c", "h")]
    classes = {r["id"]: (r["class_rows"], r["spellings"]) for r in visual.form_classes(table).collect()}
    assert classes == {"a": (4, 3), "b": (4, 3), "c": (4, 3), "h": (4, 3), "d": (1, 1)}
    assert visual.look_alikes(table.limit(0)).count() == 0


def test_hot_group_is_whole(spark):
    from quillmill.llm import pairs

    old, pairs.GROUP_SLICE = pairs.GROUP_SLICE, 7
    try:
        rows = spark.createDataFrame([(f"{i:03d}", "same text" + "​" * i) for i in range(40)], "id string, text string")
        assert visual.look_alikes(rows).count() == 40 * 39 // 2
    finally:
        pairs.GROUP_SLICE = old
