"""Answer metrics as columns, and a registry to which callers may add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import answer_form, last_number, strip

# How an answer names its choice, in words or in parentheses.
CHOICE_CUE = r"(?iU)answer\s*(?:is|:)?\s*\(?([A-Ja-j])\)?\b"
CHOICE_PAREN = r"\(([A-Ja-j])\)"

Metric = Callable[[Column, Column], Column]


def exact_match(prediction: Column, target: Column) -> Column:
    """Equal without white space at the ends."""
    return strip(prediction) == strip(target)


def normalized_match(prediction: Column, target: Column) -> Column:
    """Equal in the answer form."""
    return answer_form(prediction) == answer_form(target)


def includes(prediction: Column, target: Column) -> Column:
    """The target's answer form is not empty and stands in the prediction's."""
    want = answer_form(target)
    return (want != "") & F.contains(answer_form(prediction), want)


def numeric_match(prediction: Column, target: Column) -> Column:
    """The last numbers differ by no more than rounding; false without a number on either side."""
    got, want = last_number(prediction), last_number(target)
    return F.coalesce(F.abs(got - want) <= F.lit(1e-9) + F.lit(1e-9) * F.abs(want), F.lit(False))


def multiple_choice(prediction: Column, target: Column) -> Column:
    """A single letter, or the letter after an "answer is" cue, or one in parentheses; prose alone is wrong."""
    want = F.lower(strip(target))
    bare = strip(prediction)
    cue = F.regexp_extract(prediction, CHOICE_CUE, 1)
    paren = F.regexp_extract(prediction, CHOICE_PAREN, 1)
    return F.when(F.length(bare) == 1, F.lower(bare) == want).when(cue != "", F.lower(cue) == want).when(paren != "", F.lower(paren) == want).otherwise(F.lit(False))


METRICS: dict[str, Metric] = {
    "exact_match": exact_match,
    "normalized_match": normalized_match,
    "includes": includes,
    "numeric_match": numeric_match,
    "multiple_choice": multiple_choice,
}


def score(metric: Column, prediction: Column, target: Column, metrics: dict[str, Metric] | None = None) -> Column:
    """Score by the metric named in each row; a row with an unknown name raises."""
    chosen = F.when(F.lit(False), F.lit(False))
    for name, f in (metrics or METRICS).items():
        chosen = chosen.when(metric == name, f(prediction, target))
    return F.coalesce(chosen.otherwise(F.raise_error(F.concat(F.lit("unknown metric: "), F.coalesce(metric, F.lit("null")))).cast("boolean")), F.lit(False))
