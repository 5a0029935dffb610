"""Random texts of ASCII, blanks, control characters, accents, kana, signs and astral characters."""

from __future__ import annotations

import random

POOL = list("abcxyz ABC019 .,;!?-_'\"\t\n\r") + ["\x1c", "\x85", "é", "ü", "é", " ", "　", "か", "カ", "゙", "漢", "字", "。", "「", "𠮷", "🍣", "ß", "ﬁ", "Ａ", "​"]


def random_text(rng: random.Random, longest: int = 40) -> str:
    out = []
    for _ in range(rng.randint(0, longest)):
        if rng.random() < 0.9:
            out.append(rng.choice(POOL))
        else:
            p = rng.randint(1, 0x2FFF)
            out.append(chr(p))
    return "".join(out)


def random_texts(seed: int, n: int = 200) -> list[str]:
    rng = random.Random(seed)
    return ["", " ", "\n", "a", "ab\r\ncd \t\n\n", *[random_text(rng) for _ in range(n)]]
