"""Full sentences of a text: where they stand and what they are made of.

A sentence runs from the end of the one before, or from a line that cannot continue it, to a closing mark. It is
full where it has enough words, a share of them grammar words of one of the languages in use, and little else than
letters and blanks. Japanese sentences are judged by their characters. A sentence may run over line ends, but not
over a blank line, an item mark, a table cell or a line that ends in a colon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# Grammar words of the languages in use.
GRAMMAR_WORDS = {
    "en": "the a an and or but of to in on at for with from by as is are was were be been has have had it its this that these those they we you he she his her their our not no nor so if when while because before after until since than which who what there only some most any each every every could would should can will may must did do does under over between into near without about",
    "fr": "le la les un une des du de et ou mais dans sur sous avec sans pour par en au aux ce cet cette ces il elle on nous vous ils elles est sont était étaient a ont avons qui que ne pas plus moins si comme quand leur leurs son sa ses notre nos tous trop aussi après avant vers chaque selon jusque encore déjà parce tandis lorsque entre puis donc",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen in im an am auf aus bei mit nach von vom zu zum zur für über unter vor hinter neben zwischen ist sind war waren wird werden hat haben hatte es er sie wir ihr man als wie wenn weil dass daß ob sich noch nur auch schon mehr weniger jeder jede jedes dieser diese dieses immer doch so während gegen ohne durch unser seine laut trotz",
    "es": "el la los las un una unos unas y o pero de del en con sin por para al a su sus lo le se es son está están era eran fue ha han hemos hay que no más menos ni si cuando como entre sobre bajo desde hasta este esta estos estas ese esa nuestro nuestra cada todo todos todas muy ya también porque tras según antes después durante mientras ella él ellos",
}
#: Fewest words (or Japanese characters) of a full sentence, and its least share of grammar words.
LEAST_WORDS, LEAST_SIGNS, GRAMMAR_SHARE = 4, 8, 0.15

_ENGLISH_ETC = {w: lang for lang in GRAMMAR_WORDS for w in GRAMMAR_WORDS[lang].split()}
ALL_GRAMMAR = frozenset(_ENGLISH_ETC)
_END = re.compile(r"""(?<![.!?…。！？])[.!?…。！？]++["'”’»」』)\]]*(?:[ ]\((?:sic|\d+)\))?(?=\s|$|[「『“"«])|[。！？]+[」』”)]*|[」』](?=\s|$)|\n[ \t]*\n|\Z""")
#: Characters that one of the ends starts with.
_MAYBE_END = re.compile("[.!?…。！？」』\n]")
_HARD = re.compile(r"[|\t<>{}=\\]|https?://|www\.|\w[:;]\s*$")
_MARK = re.compile(r"\s*(?:[-*•·‣▪◦+>#]+|\[[ xX]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_KANA = re.compile("[ぁ-ゖァ-ヺー]")
_HIRAGANA = re.compile("[ぁ-ゖ]")
_HAN = re.compile("[一-鿿々]")
_OPENING = re.compile(r"""[\s"'“‘«„「『(\[¿¡—–-]*""")
_KANA_TAIL = re.compile(r"[ぁ-ゖ][。！？!?.…」』)\s]*$")
_PARTICLE = re.compile("[はがをにでもと]")

LINK = re.compile(r"""<a\s[^>]*>[^<\n]{0,120}(?:</a>)?|\[[^\]\n]{1,120}\]\([^)\s]+\)|(?:https?://|www\.)[^\s<>"')\]|]+|(?<![\w.-])[\w-]{1,63}(?:\.[\w-]{1,63}){0,5}\.(?:test|example|invalid|com|net|org|info|html)\b(?:/[^\s<>"')\]|]*)?""")
#: A label and a list of plain words: tags, not a statement.
_LABELLED = re.compile(r"\s*\w+:\s*[^,;()\[\]{}=\"'\d]+(?:[,;][^,;()\[\]{}=\"'\d]+)+[,;]?\s*$")
_STATEMENT = re.compile(r"[{}]\s*$|[=(){}\[\]].*;\s*$|^\s*(?:def|class|return|import|from|export|const|let|var|if|for|while|raise|function|public|private|@\w+|//|#(?:include|define|if|ifdef|ifndef|endif|pragma)|\"\"\"|\})\b|^\s*[\w.\[\]\"']+\s*(?:\+?=|:)\s*\S*|\w\(.*\)\s*:?\s*$|^\s*\[[\w.]+\]\s*$|^\s*//")


def _breaks(piece: str) -> int:
    """Where the running part of a piece starts: behind its last line that no sentence can run through."""
    if "\n" not in piece and not _HARD.search(piece) and not _MARK.match(piece):
        return 0
    start = at = 0
    for line in piece.split("\n"):
        end = at + len(line) + 1
        mark = _MARK.match(line)
        if mark:
            start = at + mark.end()
        if _HARD.search(line, mark.end() if mark else 0):
            start = end
        at = end
    return min(start, len(piece))


def kind(sentence: str, closed: bool = True) -> str | None:
    """"ja" or "latin" for a full sentence, else None; an open end must be paid for with more words."""
    size = len(sentence)
    hira = len(_HIRAGANA.findall(sentence)) if not sentence.isascii() else 0
    if hira:
        signs = len(_KANA.findall(sentence)) + len(_HAN.findall(sentence))
        if signs >= 0.5 * size:
            full = signs >= LEAST_SIGNS and hira >= 0.18 * signs and _KANA_TAIL.search(sentence) and _PARTICLE.search(sentence)
            return "ja" if full else None
    words = _WORD.findall(sentence.lower())
    if len(words) < (LEAST_WORDS if closed else 2 * LEAST_WORDS) or sum(map(len, words)) + len(words) < 0.75 * size:
        return None
    return "latin" if sum(map(ALL_GRAMMAR.__contains__, words)) >= (GRAMMAR_SHARE if closed else 1.6 * GRAMMAR_SHARE) * len(words) else None


def _ends(text: str) -> Iterator[tuple[int, int]]:
    """Where sentences may end: (start, end) of each closing mark, blank line, and the end of the text."""
    upto = 0
    for c in _MAYBE_END.finditer(text):
        if c.start() >= upto:
            m = _END.match(text, c.start())
            if m:
                upto = m.end()
                yield m.span()
    yield len(text), len(text)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the full sentences of ``text``."""
    found = []
    at = 0
    for start, end in _ends(text):
        closed = end > start and text[start] != "\n"
        piece = text[at:end]
        start = at
        if len(piece) > LEAST_SIGNS:
            cut = _breaks(piece)
            start, piece = at + cut, piece[cut:]
            lead = _OPENING.match(piece).end()
            what = kind(piece[lead:].rstrip(), closed) if len(piece) - lead > LEAST_SIGNS else None
            if what:
                found.append((start + lead, end, what))
        at = end
    return found


def is_code(text: str) -> bool:
    """Whether most lines of a text of several lines are statements, assignments or calls."""
    lines = [x for x in text.split("\n") if x.strip()]
    return len(lines) > 1 and sum(bool(_STATEMENT.search(x)) and not LINK.search(x) and not _LABELLED.match(x) for x in lines) > 0.6 * len(lines)


@lru_cache(maxsize=1)
def grammar_languages() -> dict[str, str]:
    """Grammar words that occur in one language only."""
    seen: dict[str, list[str]] = {}
    for lang, words in GRAMMAR_WORDS.items():
        for w in set(words.split()):
            seen.setdefault(w, []).append(lang)
    return {w: langs[0] for w, langs in seen.items() if len(langs) == 1}
