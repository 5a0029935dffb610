"""Column functions against plain restatements on random texts."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F
from texts import random_texts

from quillmill.functions import cleaners
from quillmill.functions import text as X

TEXTS = random_texts(0)
ASSIGNED = [t for t in TEXTS if all(unicodedata.category(c) != "Cn" for c in t)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def column(spark, texts, make):
    return [r[0] for r in frame(spark, texts).orderBy("i").select(make(F.col("t"))).collect()]


def plain_normal(t):
    lines = [x.rstrip(" \t") for x in unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def test_normalize_text(spark):
    assert column(spark, TEXTS, X.normalize_text) == [plain_normal(t) for t in TEXTS]


def test_normalize_is_idempotent(spark):
    once = column(spark, TEXTS, X.normalize_text)
    assert column(spark, once, X.normalize_text) == once


def test_hash_and_id(spark):
    assert column(spark, TEXTS, X.content_hash) == [hashlib.sha1(t.encode()).hexdigest() for t in TEXTS]
    want = ["s-" + hashlib.sha1(f"s\0{7}\0{t}".encode()).hexdigest()[:16] for t in TEXTS]
    assert column(spark, TEXTS, lambda t: X.record_id(F.lit("s"), F.lit(7), t)) == want


def plain_grams(t, n):
    return ({t[i : i + n] for i in range(len(t) - n + 1)} or {t}) if t else set()


def test_char_ngrams(spark):
    for n in (1, 3, 5):
        assert [set(x) for x in column(spark, TEXTS, lambda t: X.char_ngrams(t, n))] == [plain_grams(t, n) for t in TEXTS]
        assert column(spark, TEXTS, lambda t: X.char_ngram_count(t, n)) == [len(plain_grams(t, n)) for t in TEXTS]


def test_jaccard(spark):
    rows = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


def test_ratios(spark):
    def symbols(t):
        return sum(not c.isalnum() and not c.isspace() for c in t) / len(t) if t else 0.0

    def repeats(t):
        lines = t.split("\n")
        return (len(lines) - len(set(lines))) / len(lines) if t else 0.0

    assert column(spark, ASSIGNED, X.symbol_ratio) == [symbols(t) for t in ASSIGNED]
    assert column(spark, TEXTS, X.whitespace_ratio) == [sum(c.isspace() for c in t) / len(t) if t else 0.0 for t in TEXTS]
    assert column(spark, TEXTS, X.repeat_line_ratio) == [repeats(t) for t in TEXTS]


def test_tokens_and_lengths(spark):
    assert column(spark, TEXTS, X.whitespace_tokens) == [len(t.split()) for t in TEXTS]
    assert column(spark, TEXTS, X.characters) == [len(t) for t in TEXTS]
    assert column(spark, TEXTS, X.utf8_bytes) == [len(t.encode()) for t in TEXTS]


def test_strip_collapse_mock(spark):
    assert column(spark, TEXTS, X.strip) == [t.strip() for t in TEXTS]
    flat = [" ".join(t.split()) for t in TEXTS]
    assert column(spark, TEXTS, X.collapse_whitespace) == flat
    assert column(spark, TEXTS, X.mock_answer) == [f"[mock] {t}" if t else "" for t in flat]


def test_last_number(spark):
    texts = ["no", "a 1,234.5 b", "１２", "x -3", "7.", "+", "3 and 4"]
    assert column(spark, texts, X.last_number) == [None, 1234.5, 12.0, -3.0, 7.0, None, 4.0]


def test_round4(spark):
    rows = spark.createDataFrame([(k / n,) for n in range(1, 200) for k in range(n)], "v double")
    assert [r[1] for r in rows.select("v", X.round4(F.col("v"))).collect()] == [round(r[0], 4) for r in rows.collect()]


def test_nulls_stay_null(spark):
    for f in (X.normalize_text, X.content_hash, X.char_ngrams, X.strip, X.answer_form, X.last_number):
        assert column(spark, [None], f) == [None]


def test_meta_and_json(spark):
    rows = spark.createDataFrame([(None,), ({"a": "1"},), ({"b": "2"},)], "m map<string,string>")
    got = [r[0] for r in rows.select(X.merge_meta(F.col("m"), a=F.lit("9"))).collect()]
    assert got == [{"a": "9"}, {"a": "9"}, {"a": "9", "b": "2"}]
    line = rows.select(X.record_json(F.lit("i"), F.lit("t"), F.lit("s"), F.col("m"))).first()[0]
    assert line == '{"id":"i","text":"t","source":"s"}'


def test_cleaners(spark):
    book = "題名\r\n--------\r\n凡例\r\n--------\r\n本《ほん》文［＃注］｜です\r\n底本：「本」\r\n後".encode("shift_jis")
    wrapped = "﻿head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail".encode()
    rows = spark.createDataFrame([(bytearray(book), bytearray(wrapped), bytearray(b" x\r\ny \xff "))], "a binary, b binary, c binary")
    got = rows.select(cleaners.clean_annotated_book(F.col("a")), cleaners.clean_wrapped_book(F.col("b")), cleaners.clean_code(F.col("c"))).first()
    assert tuple(got) == ("本文です", "body", "x\ny �")


def test_paragraphs(spark):
    texts = ["one two three\n\n  four five\tsix \n \nshort", "", "a\nlong enough line\nanother line here"]

    def plain(t, cut):
        return [p for p in (" ".join(x.split()) for x in re.split(cut, t)) if len(p) >= 8]

    assert column(spark, texts, cleaners.paragraphs) == [plain(t, r"\n\s*\n") for t in texts]
    assert column(spark, texts, lambda t: cleaners.paragraphs(t, True)) == [plain(t, r"\n+") for t in texts]


def test_pieces_of_tiny_steps():
    from quillmill.functions.shingles import pieces

    for texts in (["a"], ["ab", ""], ["", "abcd"], ["abcde"], [""], []):
        keys, at = pieces(texts)
        assert [int(b - a) for a, b in zip(at, at[1:])] == [min(len(t), 1) for t in texts] and len(keys) == at[-1]


def test_last_number_in_other_digits(spark):
    rows = spark.createDataFrame([("x ٣", 3.0), ("१२.५ und", 12.5), ("２，０００", 2000.0), ("none", None), (None, None), ("-1,234.5", -1234.5)], "t string, want double")
    assert all(r["got"] == r["want"] for r in rows.select("want", X.last_number(F.col("t")).alias("got")).collect())
