"""Texts as sets of five-character pieces: hashing, the shared table of distinct texts, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.shingles import HASH_BITS, HASH_MASK, pieces, shared_counts, steps
from quillmill.llm.visual import forms_of
from quillmill.plans.durable import buckets, cut, cut_by

_M1 = np.uint64(0x9E3779B97F4A7C15)
#: Words of a sketch; each of its bits is one bit of the first piece after one of the places on the hash ring.
SKETCH_WORDS = 4
MEMBERS = "id string, doc long, train boolean, held boolean, source string"
FORMS = "doc long, form string, pieces int, " + ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))


class Texts(NamedTuple):
    """Records as texts: ``members`` has one row per id, ``forms`` one row per distinct consistent form."""

    members: DataFrame
    forms: DataFrame


def ring(keys: np.ndarray, at: np.ndarray, rows: np.ndarray, places: int) -> np.ndarray:
    """For each of ``rows`` and each of ``places`` even places on the hash ring, the number of the piece that follows."""
    if places >= 128 and places & (places - 1) == 0:
        # Even places are the upper bits of a hash: counting the pieces between many of them is faster than searching.
        size = np.diff(at)
        upper = ((keys & HASH_MASK) >> np.uint64(HASH_BITS - places.bit_length() + 1)).astype(np.int64)
        upper += np.repeat(np.arange(len(size)) * places, size)
        between = np.bincount(upper, minlength=len(size) * places).reshape(len(size), places)
        return (np.cumsum(between, axis=1) - between)[rows]
    spots = (np.arange(places, dtype=np.uint64) * np.uint64((1 << HASH_BITS) // places))[None, :]
    first = np.searchsorted(keys, ((rows.astype(np.uint64) << np.uint64(HASH_BITS))[:, None] | spots).ravel()).reshape(len(rows), places)
    return first - at[:-1][rows][:, None]


def sketches(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A sketch of each text of a step: ``SKETCH_WORDS`` signed words, zero for a text without pieces."""
    out = np.zeros((len(at) - 1, SKETCH_WORDS), np.int64)
    rows = np.nonzero(np.diff(at))[0]
    if len(rows):
        first = ring(keys, at, rows, 64 * SKETCH_WORDS)
        n, start = np.diff(at)[rows][:, None], at[:-1][rows][:, None]
        bits = (((keys[start + first % n] & HASH_MASK) * _M1) >> np.uint64(63)).astype(np.uint8)
        out[rows] = np.packbits(bits, axis=1).view(np.int64)
    return out


def _doc_ids(forms: pd.Series) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) for f in forms), np.uint64, len(forms)).view(np.int64)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        form = forms_of(b["text"])
        b, form = b[(form != "").to_numpy()], form[form != ""]
        split = b["split"]
        yield pd.DataFrame({"id": b["id"].to_numpy(), "doc": _doc_ids(form), "train": (split == "train").to_numpy(bool), "held": split.isin(("validation", "test")).to_numpy(bool), "source": b["source"].to_numpy()})


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms that are new in this task: a text that a third of the rows repeat leaves each task once."""
    seen: set[int] = set()
    for b in batches:
        form = forms_of(b["text"])
        form = form[form != ""].drop_duplicates()
        docs = _doc_ids(form)
        new = np.array([d not in seen for d in docs], dtype=bool)
        seen.update(docs[new])
        yield pd.DataFrame({"doc": docs[new], "form": form.to_numpy()[new]})


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()
    for b in batches:
        b = b[~b["doc"].duplicated()]
        b = b[[d not in seen for d in b["doc"]]].reset_index(drop=True)
        seen.update(b["doc"])
        forms = list(b["form"])
        words, size = np.zeros((len(b), SKETCH_WORDS), np.int64), np.zeros(len(b), np.int32)
        for lo, hi in steps(forms):
            keys, at = pieces(forms[lo:hi])
            words[lo:hi] = sketches(keys, at)
            size[lo:hi] = np.diff(at)
        b["pieces"] = size
        for k in range(SKETCH_WORDS):
            b[f"s{k}"] = words[:, k]
        yield b


def distinct_texts(records: DataFrame, split: str | None = None, source: str | None = None) -> Texts:
    """Written tables of ``records`` (id, text, ...): ids with the hash of their form, and each form once.

    Texts that look the same share a ``doc``. Only forms that a task has not seen yet are shuffled; the ids are
    spread by id, so a text that a third of the rows repeat makes no hot partition. ``forms`` is bucketed by
    ``doc``. Null ids, null texts and blank texts are left out; an id delivered twice is one member."""
    split_col = F.lower(F.trim(F.col(split))) if split else F.lit(None).cast("string")
    source_col = F.col(source).cast("string") if source else F.lit(None).cast("string")
    there = records.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    members = there.select("id", "text", split_col.alias("split"), source_col.alias("source")).mapInPandas(_members, MEMBERS)
    members = members.groupBy("id").agg(*[F.min(c).alias(c) for c in ("doc", "train", "held", "source")])
    forms = there.select("text").mapInPandas(_forms, "doc long, form string")
    forms = forms.repartition(buckets(records.sparkSession), "doc").mapInPandas(_sketched, FORMS)
    return Texts(cut(members, "members"), cut_by(forms, "doc", "forms"))


def plausible(candidates: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) whose sizes and sketches allow ``threshold``; without any text.

    Equal bits of two sketches estimate the common share of pieces. A pair is dropped only where the estimate lies
    more than five standard errors below the threshold, counted on the pieces that the smaller text really has."""
    words = [f"s{k}" for k in range(SKETCH_WORDS)]
    table = forms.select("doc", "pieces", *words)
    side = lambda x: table.select(F.col("doc").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("pieces", *words)])
    joined = candidates.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("a_pieces", "b_pieces"), F.greatest("a_pieces", "b_pieces")
    same = F.lit(64 * SKETCH_WORDS)
    for w in words:
        same = same - F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")))
    share = (1 + threshold) / 2
    error = F.lit((share * (1 - share)) ** 0.5) / F.sqrt(F.least(F.lit(64.0 * SKETCH_WORDS), small / F.lit(2.0)))
    return joined.where((small >= large * F.lit(threshold - 1e-9)) & (same >= F.lit(64.0 * SKETCH_WORDS) * (F.lit(share) - 5 * error))).select("a", "b")


def plausible_pairs(left: tuple, right: tuple, threshold: float, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of ``left`` and ``right`` with equal key whose sizes and sketches allow ``threshold``, in steps.

    A side is (key below 2**31, pieces, sketch words as unsigned columns). Sizes make a window of the sorted right
    side, so only rows whose sizes fit are compared; sketches are judged as in ``plausible``. No key is cut."""
    (l_key, l_size, l_words), (r_key, r_size, r_words) = left, right
    order = np.argsort((r_key.astype(np.int64) << 32) | r_size, kind="stable")
    ranked = (r_key[order].astype(np.int64) << 32) | r_size[order]
    base, size = l_key.astype(np.int64) << 32, l_size.astype(np.int64)
    first = np.searchsorted(ranked, base | np.ceil(size * threshold - 1e-6).astype(np.int64))
    count = np.searchsorted(ranked, base | np.floor(size / threshold + 1e-6).astype(np.int64), side="right") - first
    places, share = 64 * len(l_words), (1 + threshold) / 2
    least = lambda n: np.ceil(places * (share - 5 * (share * (1 - share) / np.minimum(places, np.maximum(n, 1) / 2)) ** 0.5)).astype(np.int16)
    l_least, r_least, r_words = least(l_size), least(r_size[order]), [w[order] for w in r_words]
    step = np.cumsum(count) // most
    cuts = [0, *(np.nonzero(step[1:] != step[:-1])[0] + 1), len(count)] if len(count) else []
    for lo, hi in zip(cuts, cuts[1:]):
        n = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[lo:hi], n)
        differ = sum(np.bitwise_count(a[i] ^ b[j]).astype(np.int16) for a, b in zip(l_words, r_words))
        ok = places - differ >= np.minimum(l_least[i], r_least[j])
        yield i[ok], order[j[ok]]


JUDGED = "a long, b long, similarity double"


def _judge(threshold: float):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            left, right = list(b["form_a"]), list(b["form_b"])
            for lo, hi in steps([x + y for x, y in zip(left, right)]):
                part = b.iloc[lo:hi]
                a, c, common = shared_counts(left[lo:hi], right[lo:hi])
                share = common / np.maximum(a + c - common, 1)
                ok = share >= threshold
                yield pd.DataFrame({"a": part["a"].to_numpy()[ok], "b": part["b"].to_numpy()[ok], "similarity": share[ok]})

    return judge


def verified(candidates: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) of docs whose pieces overlap by ``threshold`` or more, exactly: (a, b, similarity)."""
    forms = table.select("doc", "form")
    left = plausible(candidates, table, threshold).join(forms.select(F.col("doc").alias("a"), F.col("form").alias("form_a")), "a")
    full = left.join(forms.select(F.col("doc").alias("b"), F.col("form").alias("form_b")), "b")
    return full.select("a", "b", "form_a", "form_b").mapInPandas(_judge(threshold), JUDGED)
