"""Problem 5: the language of each text and of each stretch of a mixed text, by rank-order profiles.

Texts are read as letter classes (Latin letters with their accents; hiragana, katakana and Chinese signs are one
class each). A profile is a language's ``KEPT`` most frequent n-grams of one to three classes, in order. A text's or
sentence's own most frequent n-grams are compared with each profile by out-of-place distance: the sum of the rank
differences, ``KEPT`` for an n-gram that the profile lacks. The nearest profile wins; the confidence is the relative
distance to the runner-up. Profiles are trained on a bounded sample of about ``TRAIN_ROWS`` labelled rows (chosen by
a hash of the id), then once more on the sentences that the first profiles confirm, so wrong labels wash out.

A sentence speaks for another language than the text's main one only where its distance is clear (``CLEAR``) and
its grammar words agree; single foreign words or names do neither.

Defined results: null and blank texts, texts without a full sentence, and program code (most lines are statements and
less than half of the text is in sentences, so that they are its comments) have no language; every other text with a
sentence has one, however few they are; an id delivered twice is reported once; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.sentences import grammar_languages, is_code, spans
from quillmill.functions.shingles import code_points, steps
from quillmill.llm.visual import forms_of

LANGUAGES = ("en", "ja", "fr", "de", "es")
#: N-grams kept in a profile, rows that train the profiles.
KEPT, TRAIN_ROWS = 300, 3000
#: Relative distance to the runner-up from which a single sentence speaks for itself.
CLEAR = 0.06
_BITS = 6
_STARTS = (0, 1 << _BITS, (1 << _BITS) + (1 << 2 * _BITS))
_SPACE = _STARTS[2] + (1 << 3 * _BITS)
# Letters beside a-z that the languages use.
ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõùúûüÿßœ"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Letter class of each code point of the basic plane; 0 stands for everything between words."""
    table = np.zeros(0x10000, np.uint8)
    for k, letter in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED):
        for ch in (letter, letter.upper()):
            if len(ch) == 1:
                table[ord(ch)] = k + 1
    table[0x3041:0x3097], table[0x30A1:0x30FD], table[0x4E00:0xA000] = 61, 62, 63
    table[0x3005] = 63
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, n-gram code) of every n-gram of one to three classes that isn't only blank."""
    points, at = code_points(texts)
    c = _classes()[np.minimum(points, 0xFFFF)].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    docs, codes = [doc[c > 0]], [c[c > 0]]
    code = c
    for n in (2, 3):
        code = (code[:-1] << _BITS) | c[n - 1 :]
        same = doc[: len(code)] == doc[n - 1 :]
        docs.append(doc[: len(code)][same])
        codes.append(code[same] + _STARTS[n - 1])
    return np.concatenate(docs), np.concatenate(codes)


class Profiles:
    """Ranked n-grams of each language, and the distance of texts to them."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        """``counts``: occurrences by n-gram code for each of ``LANGUAGES``."""
        tops = []
        for lang in LANGUAGES:
            order = np.argsort(-counts[lang], kind="stable")[:KEPT]
            tops.append(order[counts[lang][order] > 0])
        pooled = sum(counts[lang] / max(counts[lang].sum(), 1) for lang in LANGUAGES)
        union = np.unique(np.concatenate(tops))
        union = union[np.argsort(-pooled[union], kind="stable")]
        self.number = np.full(_SPACE, -1, np.int32)
        self.number[union] = np.arange(len(union))
        self.ranks = np.full((len(LANGUAGES), len(union)), KEPT, np.int64)
        for k, top in enumerate(tops):
            self.ranks[k, self.number[top]] = np.arange(len(top))

    def distances(self, texts: list[str]) -> np.ndarray:
        """Out-of-place distance of each text to each profile, as a share of the greatest possible."""
        out = np.ones((len(texts), len(LANGUAGES)))
        for lo, hi in steps(texts, 400_000):
            doc, code = ngrams(texts[lo:hi])
            known = self.number[code]
            key = (doc[known >= 0] << 16) | known[known >= 0]
            key.sort()
            if not len(key):
                continue
            start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            count = np.minimum(np.diff(np.append(start, len(key))), 0xFFFF)
            unit, gram = key[start] >> 16, key[start] & 0xFFFF
            order = np.sort((unit << 32) | ((0xFFFF - count) << 16) | gram)
            unit, gram = order >> 32, order & 0xFFFF
            rank = np.arange(len(unit)) - np.searchsorted(unit, unit)
            most = rank < KEPT
            unit, gram, rank = unit[most], gram[most], rank[most]
            size = np.maximum(np.bincount(unit, minlength=hi - lo), 1)
            for k in range(len(LANGUAGES)):
                out[lo:hi, k] = np.bincount(unit, np.abs(self.ranks[k, gram] - rank), hi - lo) / size / KEPT
        return out


def _best(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest profile and confidence of each row of distances."""
    order = np.sort(distances, axis=1)
    return distances.argmin(axis=1), (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1], 1e-9)


def _grammar_vote(sentence: str) -> str | None:
    """Language of most of the grammar words that occur in one language only."""
    only = grammar_languages()
    votes: dict[str, int] = {}
    for w in sentence.lower().split():
        lang = only.get(w.strip(".,;:!?\"'()«»“”„¿¡"))
        if lang:
            votes[lang] = votes.get(lang, 0) + 1
    best = max(votes, key=votes.get, default=None)
    return best if best and votes[best] * 2 > sum(votes.values()) else None


def _own_sentences(text: str) -> list[tuple[int, int, str]]:
    """Full sentences of a text, however few; a sentence in the comments of program code isn't the text's own."""
    found = spans(text)
    return [] if found and 2 * sum(b - a for a, b, _ in found) < len(text) and is_code(text) else found


def _read(texts: list[str], profiles: Profiles, whole: bool = True) -> tuple[list[list[tuple[int, int, int, float]]], np.ndarray, np.ndarray]:
    """Stretches (start, end, language, confidence) of each text, its main language, and, where ``whole``, the
    confidence of the whole text's own profile."""
    found = [_own_sentences(t) for t in texts]
    lines = [t[a:b] for t, s in zip(texts, found) for a, b, _ in s]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in found])
    distance = profiles.distances(lines) if lines else np.ones((0, len(LANGUAGES)))
    best, sure = _best(distance) if lines else (np.zeros(0, np.int64), np.zeros(0))
    weight = np.array([len(x) for x in lines], float)
    total = np.zeros((len(texts), len(LANGUAGES)))
    if lines:
        np.add.at(total, (owner, best), weight * (0.05 + sure))
    main = total.argmax(axis=1)
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    flat = [(a, b, kind) for s in found for a, b, kind in s]
    for k, (a, b, kind) in enumerate(flat):
        d = owner[k]
        lang = int(best[k])
        japanese = LANGUAGES.index("ja")
        if kind == "ja" or lang == japanese:
            lang = japanese if kind == "ja" else int(np.delete(np.arange(5), japanese)[np.delete(distance[k], japanese).argmin()])
        if lang != main[d] and kind != "ja" and (sure[k] < CLEAR or _grammar_vote(lines[k]) != LANGUAGES[lang]):
            vote = _grammar_vote(lines[k])
            lang = LANGUAGES.index(vote) if vote and vote != LANGUAGES[main[d]] and sure[k] < CLEAR and distance[k, LANGUAGES.index(vote)] < distance[k, main[d]] else int(main[d])
        out[d].append((a, b, lang, float(sure[k])))
    for d, parts in enumerate(out):
        if parts:
            share = np.bincount([p[2] for p in parts], [p[1] - p[0] for p in parts], len(LANGUAGES))
            main[d] = share.argmax()
    distance = np.ones((len(texts), len(LANGUAGES)))
    there = [d for d, parts in enumerate(out) if parts]
    if there and whole:
        distance[there] = profiles.distances([texts[d] for d in there])
    order = np.sort(distance, axis=1)
    confidence = (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1], 1e-9)
    return out, main, confidence


def label_of(raw: Column) -> Column:
    """A language label without blanks and letter case."""
    return F.lower(F.trim(F.regexp_replace(raw, "[\\s\\u00a0\\u3000]+", " ")))


def train(rows: DataFrame, most: int = TRAIN_ROWS) -> Profiles:
    """Profiles from a bounded sample of ``rows`` (id, text, label)."""
    named = rows.where(label_of(F.col("label")).isin(*LANGUAGES) & (F.trim("text") != ""))
    every = max(1, rows.count() // most)
    sample = named.where(F.pmod(F.xxhash64("id", F.lit("profile")), F.lit(every)) == 0).select("text", label_of(F.col("label")).alias("label")).limit(2 * most).toPandas()
    lines, labels = [], []
    for text, label in zip(forms_of(sample["text"]) if len(sample) else [], sample["label"]):
        for a, b, kind in spans(text):
            if (kind == "ja") == (label == "ja"):
                lines.append(text[a:b])
                labels.append(LANGUAGES.index(label))
    labels = np.array(labels, np.int64)
    profiles = Profiles(_counted(lines, labels))
    if lines:
        best, _ = _best(profiles.distances(lines))
        agreed = np.nonzero(best == labels)[0]
        if len(agreed):
            profiles = Profiles(_counted([lines[i] for i in agreed], labels[agreed]))
    return profiles


def _counted(lines: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    counts = {lang: np.zeros(_SPACE) for lang in LANGUAGES}
    for lo, hi in steps(lines, 400_000):
        doc, code = ngrams(lines[lo:hi])
        for k, lang in enumerate(LANGUAGES):
            counts[lang] += np.bincount(code[labels[lo:hi][doc] == k], minlength=_SPACE)
    return counts


SEGMENTS = "id string, segment int, first int, last int, language string, confidence double"
DOCUMENTS = "id string, label string, language string, confidence double, languages array<string>, sentence_share double"


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for b in batches:
        b = b[b["id"].notna() & b["text"].notna()].reset_index(drop=True)
        forms = list(forms_of(b["text"])) if len(b) else []
        for lo, hi in steps(forms):
            yield b.iloc[lo:hi], forms[lo:hi]


def _segment(handed):
    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, forms in _texts(batches):
            found, _, _ = _read(forms, handed.value, False)
            rows = []
            for i, parts in zip(part["id"], found):
                number = 0
                run: list | None = None
                for a, b, lang, sure in parts:
                    if run and run[3] == lang:
                        run[2], run[4] = b, max(run[4], sure)
                        continue
                    if run:
                        rows.append((i, number, *run[1:3], LANGUAGES[run[3]], run[4]))
                        number += 1
                    run = [i, a, b, lang, sure]
                if run:
                    rows.append((i, number, *run[1:3], LANGUAGES[run[3]], run[4]))
            yield pd.DataFrame(rows, columns=["id", "segment", "first", "last", "language", "confidence"])

    return segment


def _document(handed, whole: bool):
    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, forms in _texts(batches):
            found, main, confidence = _read(forms, handed.value, whole)
            share = [sum(p[1] - p[0] for p in parts) / max(len(t.strip()), 1) for parts, t in zip(found, forms)]
            has = [bool(parts) for parts in found]
            yield pd.DataFrame({
                "id": part["id"].to_numpy(), "label": part["label"].to_numpy(),
                "language": [LANGUAGES[m] if h else None for m, h in zip(main, has)],
                "confidence": [float(c) if h else None for c, h in zip(confidence, has)],
                "languages": [sorted({LANGUAGES[p[2]] for p in parts}) if h else [] for parts, h in zip(found, has)],
                "sentence_share": share,
            })

    return document


def documents(rows: DataFrame, profiles: Profiles | None = None, confidence: bool = True) -> DataFrame:
    """Language, confidence and all languages of each row of ``rows`` (id, text, label), one row per id.

    Without ``confidence`` only sentences are compared with the profiles, not the whole text once more."""
    handed = rows.sparkSession.sparkContext.broadcast(profiles or train(rows))
    read = rows.select("id", "text", "label").mapInPandas(_document(handed, confidence), DOCUMENTS)
    return read.dropDuplicates(["id"])


def segments(rows: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """The stretches of one language of each text: places are in the consistent form."""
    handed = rows.sparkSession.sparkContext.broadcast(profiles or train(rows))
    return rows.select("id", "text").mapInPandas(_segment(handed), SEGMENTS).dropDuplicates(["id", "segment"])


def mislabelled(rows: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(id, language) of texts whose label is missing, wrong, or can't be right because they hold several languages."""
    read = documents(rows, profiles, confidence=False).where(F.size("languages") > 0)
    named = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(label_of(F.col("label")), F.lit("")), "[-,/ +]+"), lambda x: x.isin(*LANGUAGES))))
    wrong = (F.size("languages") > 1) | (F.to_json(named) != F.to_json("languages"))
    return read.where(wrong).select("id", F.explode("languages").alias("language"))
