"""Problem 3: per-text quality statistics, and which texts are not prose.

Statistics are exact and per row. A classifier of boosted trees on these statistics is fitted on a bounded sample of
about ``TRAIN_ROWS`` rows (chosen by a hash of the id). Its labels are weak: several voters that look at other things
than the statistics (what the row's own domain says, whether lines parse as statements, table cells, marked or short
lines, character noise, and how many words stand between closing marks) must agree, or the row trains nothing. Composed texts of known kind join the sample. The
probabilities are calibrated on one part of a holdout of hand-written texts that is never trained on; the other part
measures them. Scores are given to every row.

Defined results: a null text has null statistics, a blank text zeros, and neither is ever a case; an id delivered
twice is reported once; texts are measured whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.boosting import BoostedTrees
from quillmill.llm.checked import holdout, seeds
from quillmill.llm.sentences import ALL_GRAMMAR, is_code, spans
from quillmill.functions.shingles import code_points
from quillmill.llm.visual import consistent_form, forms_of

#: Rows of the weakly labelled sample.
TRAIN_ROWS = 4000
#: Probability of prose under which a text is reported.
PROSE_LEAST = 0.5
FEATURES = ("chars", "words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio", "kana_ratio", "lines", "mean_line", "end_mark_lines", "item_lines", "common_words", "distinct_words", "sentences", "sentence_share")
_CLASSES = ("letter", "upper", "digit", "space", "newline", "kana", "symbol")
_ENDS = tuple('.!?…。！？"”’»」』)')
_ITEMS = ("-", "*", "•", "·", "+", "#", "|", ">", "[", "(", "1", "2", "3", "4", "5", "6", "7", "8", "9")


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Character class of each code point of the basic plane; others count as letters."""
    table = np.zeros(0x10000, np.uint8)
    for p in range(0x10000):
        c = unicodedata.category(chr(p))
        if p == 10:
            table[p] = 4
        elif c in ("Zs", "Zl", "Zp", "Cc"):
            table[p] = 3
        elif 0x3041 <= p <= 0x30FF:
            table[p] = 5
        elif c == "Lu":
            table[p] = 1
        elif c[0] == "L" or c[0] == "M":
            table[p] = 0
        elif c[0] == "N":
            table[p] = 2
        else:
            table[p] = 6
    return table


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text, in the consistent form."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not texts:
        return out
    points, at = code_points(texts)
    kinds = _class_table()[np.minimum(points, 0xFFFF)]
    kinds[points > 0xFFFF] = 0
    lens = np.maximum(np.diff(at), 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    share = np.bincount(doc * 7 + kinds, minlength=7 * len(texts)).reshape(len(texts), 7) / lens[:, None]
    for i, t in enumerate(texts):
        words = t.lower().split()
        bare = [w.strip(".,;:!?\"'()«»“”„") for w in words]
        lines = [x for x in t.split("\n") if x.strip()]
        found = spans(t)
        n, m = max(len(words), 1), max(len(lines), 1)
        out[i] = (
            len(t), len(words), sum(map(len, bare)) / n, share[i, 6], share[i, 2], share[i, 1], share[i, 3] + share[i, 4], share[i, 5],
            len(lines), len(t) / m, sum(x.rstrip().endswith(_ENDS) for x in lines) / m, sum(x.lstrip().startswith(_ITEMS) for x in lines) / m,
            sum(map(ALL_GRAMMAR.__contains__, bare)) / n, len(set(bare)) / n, len(found), sum(b - a for a, b, _ in found) / max(len(t), 1),
        )
    return out


_CLOSING = re.compile(r"[.!?…]+[\"'”’»)]*(?=\s|$)|[。！？」』]+")
_CELL = re.compile(r"[|\t]|\s[/»·=]\s|,\S+,|:\s|\.\.\.|\S {2,}\S")
_NOISE = re.compile(r"&#\d+;|\\x[0-9a-f]{2}|[\x00-\x08\x0e-\x1f\ufffd]|\b(?=\w*\d)[0-9a-f]{4,8}\b|[{}\[\]<>^~|\\`]")
# How domains name running text, and what is none.
PROSE_DOMAINS, OTHER_DOMAINS = ("prose", "literature", "reports"), ("code", "configuration", "config")


def weak_label(text: str, domain: str | None) -> int | None:
    """1 for prose, 0 for structural junk, None where the voters disagree or none of them speaks; for consistent forms."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None
    dense = not text.isascii() and sum(x >= "\u2e80" for x in text) > 0.5 * len(text)
    # Units of a stretch: words, or pairs of signs where words aren't parted.
    size = (lambda x: len(x) / 2) if dense else (lambda x: len(x.split()))
    clauses = [size(x) for x in _CLOSING.split(text) if x.strip()]
    in_long = sum(x for x in clauses if x >= 5) / max(sum(clauses), 1)
    closed = len(_CLOSING.findall(text)) / max(size(text), 1)
    said = (domain or "").strip().lower()
    junk = [
        said.endswith(OTHER_DOMAINS), is_code(text), sum(bool(_CELL.search(x)) for x in lines) > 0.6 * len(lines), sum(x.lstrip().startswith(_ITEMS) for x in lines) > 0.6 * len(lines),
        len(lines) > 2 and sum(size(x) <= 4 for x in lines) > 0.8 * len(lines), len(_NOISE.findall(text)) > 0.02 * len(text),
    ]
    prose = [said.endswith(PROSE_DOMAINS), in_long > 0.8 and 0.02 < closed < 0.2]
    # Comments make long clauses too: where the row's domain and its lines both say code, that settles it.
    if (junk[0] and junk[1]) or (any(junk) and not prose[1]):
        return 0
    return 1 if all(prose) and not any(junk[1:]) else None


_STATS = "id string, prose double, " + ", ".join(f"{f} double" for f in FEATURES)


def _measure(model: BoostedTrees | None):
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                there = part["text"].notna().to_numpy()
                x = np.full((len(part), len(FEATURES)), np.nan)
                x[there] = features(list(forms_of(part["text"][there])))
                prose = np.full(len(part), np.nan)
                if model is not None and there.any():
                    prose[there] = model.probability(x[there])
                out = pd.DataFrame(x, columns=FEATURES)
                out.insert(0, "prose", prose)
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    return measure


def statistics(rows: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """The statistics of each row, with the calibrated probability of prose where a model is given."""
    found = rows.select("id", "text").mapInPandas(_measure(model), _STATS)
    return found.select("id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("prose", *FEATURES)])


def fitted(x: np.ndarray, y: np.ndarray, use: Sequence[str] = FEATURES) -> BoostedTrees:
    """Trees on the weakly labelled rows and the seeds, calibrated on every other text of the holdout; ``use`` names the
    statistics that they may look at."""
    hidden = [k for k, f in enumerate(FEATURES) if f not in use]
    seed, held = seeds(), holdout()[::2]
    x = np.concatenate([x.reshape(-1, len(FEATURES)), features([consistent_form(t) for t, _ in seed])])
    y = np.concatenate([y, [label for _, label in seed]])
    check = features([consistent_form(t) for t, _ in held])
    x[:, hidden], check[:, hidden] = 0, 0
    return BoostedTrees().fit(x, y).calibrate(check, np.array([label for _, label in held], float))


def calibration_error(model: BoostedTrees, parts: int = 5) -> tuple[float, float]:
    """(share of wrong verdicts, expected calibration error) on the holdout's other half."""
    held = holdout()[1::2]
    p = model.probability(features([consistent_form(t) for t, _ in held]))
    y = np.array([label for _, label in held], float)
    part = np.minimum((p * parts).astype(int), parts - 1)
    error = sum(abs(p[part == k].mean() - y[part == k].mean()) * (part == k).mean() for k in range(parts) if (part == k).any())
    return float(((p >= PROSE_LEAST) != (y == 1)).mean()), float(error)


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = list(forms_of(b["text"]))
        labels = [weak_label(t, d) for t, d in zip(forms, b["domain"])]
        out = pd.DataFrame(features(forms), columns=FEATURES)
        out.insert(0, "label", pd.array(labels, dtype="Int32"))
        yield out[out["label"].notna()]


def training_sample(rows: DataFrame, most: int = TRAIN_ROWS) -> pd.DataFrame:
    """The bounded, weakly labelled sample: ``label`` and the statistics."""
    every = max(1, rows.count() // most)
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & (F.trim("text") != ""))
    domain = F.col("meta")["domain"] if "meta" in rows.columns else F.lit(None).cast("string")
    labelled = sample.select("id", "text", domain.alias("domain")).orderBy(F.xxhash64("id"), "text").limit(2 * most)
    schema = "label int, " + ", ".join(f"{f} double" for f in FEATURES)
    return labelled.mapInPandas(_labelled, schema).toPandas()


def train(rows: DataFrame, most: int = TRAIN_ROWS) -> BoostedTrees:
    """The classifier of a table of rows (id, text, and meta with the domain where there is one)."""
    got = training_sample(rows, most)
    return fitted(got[list(FEATURES)].to_numpy(float), got["label"].to_numpy(float))


def not_prose(rows: DataFrame) -> DataFrame:
    """Ids of rows whose text is mostly not sentences."""
    scored = statistics(rows, train(rows))
    return scored.where((F.col("chars") > 0) & (F.col("prose") < PROSE_LEAST)).select("id").distinct()
