"""Shared helpers of the tests of training-data operators."""

from __future__ import annotations

import random

import pytest

WORDS = "lamp harbour window letter river table garden winter market bridge paper engine silver morning valley".split()


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def sentence(rng):
    def make(n: int = 9) -> str:
        words = []
        for k in range(n):
            words.append(rng.choice(["the", "a", "of", "and", "with", "in"]) if k % 2 == 0 else rng.choice(WORDS) + rng.choice(["", "s", "er", rng.choice("bcdfgh") + "le"]))
        return (" ".join(words)).capitalize() + "."

    return make
