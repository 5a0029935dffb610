"""Columns on text: normalisation, identity, n-grams, ratios, counts.

Every function is null in, null out unless it says otherwise, and works on whole texts. Classes of characters are
spelled out where Java's own are narrower than Unicode's."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from quillmill.functions.shingles import pieces, steps

# Unicode white space, letters and digits as Java patterns.
WHITE = r"\s\x1c-\x1f\x{85}\p{Z}"
WORDLIKE = r"\p{L}\p{N}"
# A number in an answer; the blanks and punctuation that answer comparison turns into one blank.
NUMBER = r"([-+]?\p{Nd}[\p{Nd},]*\.?\p{Nd}*)"
PUNCTUATION = r"""[""" + WHITE + r"""!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~。、，．！？「」『』（）：；]+"""


def _by_value(text: pd.Series, form: Callable[[str], str]) -> pd.Series:
    """``form`` once per distinct value of a batch; null stays null."""
    codes, values = pd.factorize(text)
    done = np.array([form(v) for v in values] + [None], dtype=object)
    return pd.Series(done[codes], index=text.index, dtype=object)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; texts in ASCII pass through."""
    return _by_value(text, lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return _by_value(text, lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_digits(text: pd.Series) -> pd.Series:
    """Compatibility composition, and the decimal digits of every script as 0 to 9."""

    def plain(t: str) -> str:
        t = unicodedata.normalize("NFKC", t)
        return "".join(str(unicodedata.decimal(c)) if c > "\x7f" and c.isdecimal() else c for c in t)

    return _by_value(text, lambda t: t if t.isascii() else plain(t))


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Compatibility composition, then full case folding."""
    return _by_value(text, lambda t: unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(DoubleType())
def round4(value: pd.Series) -> pd.Series:
    """Rounds the exact binary value to four places, as Python does."""
    return value.map(lambda v: round(v, 4) if v == v else v)


def normalize_text(text: Column) -> Column:
    """Canonical composition, ``\\n`` line ends, no blanks or tabs at line ends, no blank first or last lines."""
    unix = F.regexp_replace(nfc(text), r"\r\n?", "\n")
    # A run of blanks is only tried from its start, so long runs stay linear.
    bare = F.regexp_replace(unix, r"(?<![ \t])[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(bare, r"\A\n+|\n+\z", "")


def content_hash(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes, in hexadecimal."""
    return F.sha1(F.encode(text, "UTF-8"))


def record_id(source: Column, index: Column, text: Column) -> Column:
    """``source-`` and 16 digits of the SHA-1 of source, index and text, joined by zero characters."""
    zero = F.lit("\0")
    return F.concat(source, F.lit("-"), F.substring(F.sha1(F.encode(F.concat(source, zero, index.cast("string"), zero, text), "UTF-8")), 1, 16))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of code points, in order; a shorter text is its only n-gram, an empty text has none.

    A vectorised function: Spark's own ``substring`` walks from the start of the text for every n-gram."""
    if n <= 0:
        raise ValueError("n must be positive")

    def grams(t: str | None) -> list[str] | None:
        if t is None:
            return None
        return list(dict.fromkeys(t[i : i + n] for i in range(max(len(t) - n + 1, 1)))) if t else []

    return F.pandas_udf(lambda s: s.map(grams), ArrayType(StringType()))(text)


def char_ngram_count(text: Column, n: int = 5) -> Column:
    """Number of distinct n-grams, by sorted hashes: no n-gram leaves the worker. 0 for null."""
    if n <= 0:
        raise ValueError("n must be positive")

    def count(s: pd.Series) -> pd.Series:
        texts = [t or "" for t in s]
        out = np.zeros(len(texts), np.int64)
        for lo, hi in steps(texts):
            out[lo:hi] = np.diff(pieces(texts[lo:hi], n)[1])
        return pd.Series(out, index=s.index)

    return F.pandas_udf(count, LongType())(text)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays of distinct elements: 1 for two empty ones, 0 for one."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common.cast("double") / union)


def characters(text: Column) -> Column:
    return F.length(text).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def whitespace_tokens(text: Column) -> Column:
    """Number of runs of other characters than white space."""
    return F.size(F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")).cast("long")


def symbol_count(text: Column) -> Column:
    """Characters that are neither letters nor numbers nor white space."""
    return F.length(F.regexp_replace(text, f"[{WORDLIKE}{WHITE}]", "")).cast("long")


def whitespace_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{WHITE}]", ""))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines that repeat an earlier line; an empty text has none."""
    lines = F.split(text, "\n", -1)
    return F.when(text == "", F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` in double precision, 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def symbol_ratio(text: Column) -> Column:
    return ratio(symbol_count(text), F.length(text))


def whitespace_ratio(text: Column) -> Column:
    return ratio(whitespace_count(text), F.length(text))


def repeat_line_ratio(text: Column) -> Column:
    return ratio(repeated_lines(text), line_count(text))


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"[{WHITE}]+", " "), r"\A | \z", "")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|(?<![{WHITE}])[{WHITE}]+\z", "")


def answer_form(text: Column) -> Column:
    """The form in which answers are compared: folded, runs of blanks and punctuation as one blank."""
    return strip(F.regexp_replace(nfkc_casefold(text), PUNCTUATION, " "))


def last_number(text: Column) -> Column:
    """The last number in a text as a double, commas dropped; null if there is none."""
    found = F.regexp_extract_all(nfkc_digits(text), F.lit(NUMBER), F.lit(1))
    plain = F.translate(F.try_element_at(found, F.lit(-1)), ",", "")
    return plain.try_cast("double")


def mock_answer(prompt: Column) -> Column:
    """``[mock] `` and the prompt with white space collapsed; a blank prompt gives an empty answer."""
    flat = collapse_whitespace(prompt)
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit("[mock] "), flat))


def truncated(text: Column, size: int = 120) -> Column:
    return F.substring(text, 1, size)


def merge_meta(meta: Column, **updates: Column) -> Column:
    """``meta`` with keys set; an existing key is replaced, a null map counts as empty."""
    new = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), v)])
    old = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~k.isin(*updates))
    return F.map_concat(kept, new)


def record_json(id: Column, text: Column, source: Column, meta: Column) -> Column:
    """One record as a JSON object; an empty ``meta`` is left out."""
    return F.to_json(F.struct(id.alias("id"), text.alias("text"), source.alias("source"), F.when(F.size(meta) > 0, meta).alias("meta")))
