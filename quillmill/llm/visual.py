"""Problem 2: one consistent form for texts that look the same.

``consistent_form`` decomposes compatibly, maps look-alike letters to the Latin letter they resemble, composes
again, maps Chinese signs and kana drawn alike, removes default-ignorable characters, maps every blank to a space and every line end to ``\\n``, and drops
blanks at line ends. Characters whose compatibility form is visibly different (superscripts, subscripts, circled
and squared signs, fractions) stay as they are. Full case folding is a second, coarser form: it makes the blocks
in which texts are compared, while the form that keeps letter case decides.

Defined results: a null text has a null form; a blank text has the form ``""`` and is never a case; rows repeated
under one id count once; texts of any length are processed whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.llm.pairs import within_groups
from quillmill.plans.durable import cut

# Letters of other scripts and the Latin letters (or signs) they cannot be told apart from.
LOOKS_LIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԁ": "d", "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Ԛ": "Q", "Ԝ": "W", "ӏ": "l", "ѵ": "v", "ү": "y", "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n",
    "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "‐": "-", "‑": "-", "ꞏ": "·", "․": ".",
}
# Chinese signs and kana that are drawn alike.
SIGNS_LIKE = {"一": "ー", "口": "ロ", "力": "カ", "二": "ニ", "夕": "タ", "工": "エ", "八": "ハ", "卜": "ト", "丿": "ノ", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
# Kinds of compatibility mapping that change what a reader sees.
VISIBLE_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")

_LOOKS, _SIGNS = str.maketrans(LOOKS_LIKE), str.maketrans(SIGNS_LIKE)
_LINE_END = re.compile("\r\n?|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_ODD_END = re.compile("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_SUSPECT = re.compile("[" + "".join(LOOKS_LIKE) + "]")
_LIKE_SIGNS = re.compile("[" + "".join(SIGNS_LIKE) + "]")
_WIDE_BLANK = re.compile(r"[^\S\n ]")
_AT_END = re.compile(r"(?<! ) +(?=\n|\Z)")


def _class(points: list[int]) -> re.Pattern:
    """A pattern for single code points, written as ranges."""
    parts, start, last = [], points[0], points[0]
    for p in [*points[1:], -9]:
        if p == last + 1:
            last = p
            continue
        parts.append(f"\\U{start:08x}-\\U{last:08x}")
        start = last = p
    return re.compile("[" + "".join(parts) + "]")


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of default-ignorable characters and of those whose folding would be seen."""
    ignorable = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
    visible = []
    for p in range(sys.maxunicode + 1):
        ch = chr(p)
        if p > 0x200A and unicodedata.category(ch) == "Cf" and p < 0xE0000:
            ignorable.add(p)
        if unicodedata.decomposition(ch).startswith(VISIBLE_KINDS):
            visible.append(p)
    return _class(sorted(ignorable)), _class(visible)


def consistent_form(text: str | None, fold_case: bool = False) -> str | None:
    """The one form shared by all texts that look like ``text``; with ``fold_case`` also blind to letter case."""
    if text is None:
        return None
    if not text.isascii():
        hidden, visible = _patterns()
        if hidden.search(text):
            text = hidden.sub("", text)
        if _SUSPECT.search(text) or not unicodedata.is_normalized("NFKC", text):
            if visible.search(text):
                pieces, at = [], 0
                for m in visible.finditer(text):
                    pieces += [unicodedata.normalize("NFKD", text[at : m.start()]), m.group()]
                    at = m.end()
                text = "".join(pieces) + unicodedata.normalize("NFKD", text[at:])
            else:
                text = unicodedata.normalize("NFKD", text)
            text = unicodedata.normalize("NFC", text.translate(_LOOKS))
        if _LIKE_SIGNS.search(text):
            text = unicodedata.normalize("NFC", text.translate(_SIGNS))
    if _ODD_END.search(text):
        text = _LINE_END.sub("\n", text)
    if _WIDE_BLANK.search(text):
        text = _WIDE_BLANK.sub(" ", text)
    if " \n" in text or text[-1:] == " ":
        text = _AT_END.sub("", text)
    text = text.strip("\n")
    if not text.strip():
        return ""
    return text.casefold() if fold_case else text


def forms_of(texts: pd.Series, fold_case: bool = False) -> pd.Series:
    """``consistent_form`` once per distinct value of a batch."""
    codes, values = pd.factorize(texts, use_na_sentinel=True)
    done = np.array([consistent_form(v, fold_case) for v in values] + [None], dtype=object)
    return pd.Series(done[codes], index=texts.index, dtype=object)


def form_column(text: Column, fold_case: bool = False) -> Column:
    """``consistent_form`` as a vectorised column."""

    def apply(s: pd.Series) -> pd.Series:
        return forms_of(s, fold_case)

    return F.pandas_udf(apply, StringType())(text)


FINGERPRINTS = "id string, fold long, form binary, raw long"


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b = b[b["id"].notna() & b["text"].notna()]
        codes, values = pd.factorize(b["text"])
        forms = [consistent_form(v) for v in values]
        fold = np.array([xxhash.xxh3_64_intdigest(f.casefold().encode("utf-8", "surrogatepass")) for f in forms], dtype=np.uint64).view(np.int64)
        form = np.array([xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")) for f in forms] + [b""], dtype=object)[:-1]
        raw = np.array([xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values], dtype=np.uint64).view(np.int64)
        blank = np.array([not f for f in forms], dtype=bool)
        keep = ~blank[codes] if len(codes) else np.zeros(0, bool)
        codes = codes[keep]
        yield pd.DataFrame({"id": b["id"].to_numpy()[keep], "fold": fold[codes], "form": form[codes], "raw": raw[codes]})


def fingerprints(rows: DataFrame) -> DataFrame:
    """(id, fold, form, raw) of each id: hashes of the case-folded form, of the form and of the text itself.

    Only hashes leave the Python workers, so no text is shuffled."""
    return rows.select("id", "text").mapInPandas(_fingerprints, FINGERPRINTS).groupBy("id").agg(F.min(F.struct("fold", "form", "raw")).alias("_p")).select("id", "_p.*")


def look_alikes(rows: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` whose texts look the same but are different strings.

    ``rows``: ``id``, ``text`` and any other columns. Blocks are groups of equal case-folded form; in a block the
    form that keeps letter case decides."""
    prints = cut(fingerprints(rows), "prints")
    blocks = prints.groupBy("fold", "form").agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").drop("lo", "hi")
    mixed = prints.join(blocks, ["fold", "form"])
    return within_groups(mixed, ["fold", "form"], "n", lambda a, b: a["raw"] != b["raw"]).select("id_a", "id_b")


def form_classes(rows: DataFrame) -> DataFrame:
    """One row per id: its class of texts that look the same, the class's size and number of different strings."""
    prints = cut(fingerprints(rows), "prints")
    sizes = prints.groupBy("form").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"), F.countDistinct("raw").alias("spellings"))
    return prints.join(sizes, "form").select("id", "class_id", "class_rows", "spellings")
