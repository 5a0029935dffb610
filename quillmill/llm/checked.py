"""Hand-written fragments and the texts composed of them, in two disjoint halves with known labels.

``seeds`` join every training sample, so that a thin one has both kinds; ``holdout`` is never trained on: one part of
it calibrates the classifier, the other measures it. A label says 1 for prose and 0 for what is mostly not sentences."""

from __future__ import annotations

import random

# Sentences and names of things, written by hand; the first half of each list makes the seeds.
SENTENCES = {
    "en": [
        "The harbour was quiet when the first boats came in.", "Nobody spoke, because the fog hid the far side of the pier.", "She opened the letter twice before she read it to the others.", "They are on the table, under the old map of the coast.",
        "We measured the wall on Monday and found that the plan was wrong.", "It had been a long winter for the people of the valley.", "He asked whether the train would stop at the small station.", "There were two lamps in the window and a dog at the gate.",
        "The committee wanted a shorter summary of what had been decided.", "You should keep the keys until the new owner arrives.", "Most of the bread was gone by the time they got to the market.", "If the rain does not stop, we will stay with my aunt.",
    ],
    "fr": [
        "Le train est parti avant midi et nous sommes restés sur le quai.", "Elle a posé la lettre sur la table sans la lire.", "Les enfants ont attendu avec nous parce que la pluie ne cessait pas.", "Il faut que tu prennes ton manteau, car il fait froid dans la cour.",
        "On ne sait pas encore qui a fermé la porte de la maison.", "Nous avons mangé du pain dans la cuisine de ma tante.", "Le vieux pont est plus large que la rue qui mène au marché.", "Quand la nuit tombe, les lampes sont allumées dans toute la ville.",
    ],
    "de": [
        "Der Müller öffnete das Tor und sah auf den Fluss.", "Es war noch früh, aber die Kinder standen schon am Ufer.", "Wir haben die Kiste nicht gefunden, weil sie hinter dem Schrank stand.", "Morgen suchen wir noch einmal nach dem Schlüssel für den Keller.",
        "Die Brücke ist älter als das Haus, in dem wir wohnen.", "Er hat den Brief gelesen und ist dann nach Hause gegangen.", "Am Abend wird es kalt, und die Lampen brennen in jeder Straße.", "Niemand wusste, ob der Zug an dem kleinen Bahnhof halten würde.",
    ],
    "es": [
        "La casa estaba vacía cuando llegamos con los niños.", "Mi hermana abrió las ventanas y todos los pájaros salieron del tejado.", "No queda pan en la cocina, así que hay que ir al mercado.", "El puente es más antiguo que la calle que lleva a la plaza.",
        "Si no deja de llover, nos quedamos en la casa de mi tía.", "Nadie sabía que el tren no paraba en la estación pequeña.", "La carta estaba sobre la mesa y ella no la había leído.", "Por la noche se encienden las lámparas en todas las calles.",
    ],
    "ja": [
        "朝になると、私たちは港まで歩きました。", "風は冷たかったですが、空はとても明るかったです。", "彼女は手紙を二回読んでから机の上に置きました。", "駅まで友人を迎えに行くつもりです。",
        "古い橋は川の向こうの町まで続いています。", "雨がやまないので、今夜は叔母の家に泊まります。", "市場に着いたときには、パンはもうありませんでした。", "誰が門を閉めたのか、まだ分かっていません。",
    ],
}
# Things that lists, tables and menus name.
THINGS = {
    "en": "apples|brown sugar|two lemons|copper wire|long screws|white paint|sandpaper|garden chair|oak table|blue lamp|salt|butter|linen bag|iron hinge|old clock|green bottle".split("|"),
    "fr": "maison bleue|petite table|vieux tapis|coussin rouge|miroir|lampe|sel fin|beurre doux|fil de cuivre|chaise longue|clou|savon noir".split("|"),
    "de": "brauner Zucker|kalte Butter|frische Eier|Hefe|Milch|Salz|blaue Lampe|alte Uhr|Eichentisch|Schrauben|weiße Farbe|Seife".split("|"),
    "es": "mesa redonda|libro antiguo|ventana azul|silla|papel|sal fina|pan blanco|reloj viejo|lámpara|hilo de cobre|jabón|puerta".split("|"),
    "ja": "赤い花|古い石の道|小さな窓|白い紙|長い橋の名|町の地図|木の椅子|青い箱|銅の線|冷たい水|古い時計|丸い机".split("|"),
}
# Names for code and configuration.
NAMES = "width height total price items index folder reader limit level server colour result buffer handle parser".split()


def _split(values: list, first: bool) -> list:
    return values[: len(values) // 2] if first else values[len(values) // 2 :]


def _prose(draw: random.Random, sentences: list[str], things: list[str], gap: str) -> str:
    some = [draw.choice(sentences) for _ in range(draw.randint(2, 7))]
    kind = draw.randrange(5)
    if kind == 0:
        return gap.join(some)
    if kind == 1:
        return "\n".join(some)
    if kind == 2:
        text, wide = gap.join(some), draw.randint(24, 60)
        if not gap:
            return "\n".join(text[k : k + wide] for k in range(0, len(text), wide))
        lines, line = [], ""
        for word in text.split():
            if line and len(line) + len(word) > wide:
                lines.append(line)
                line = ""
            line = f"{line} {word}".strip()
        return "\n".join([*lines, line])
    if kind == 3:
        return "\n".join((f"「{s}」" if not gap else f"“{s}”") for s in some)
    return gap.join(some) + "\n" + "\n".join(f"- {x}" for x in draw.sample(things, 2)) + "\n" + gap.join(draw.choice(sentences) for _ in range(3))


def _junk(draw: random.Random, things: list[str], names: list[str]) -> str:
    n = draw.randint(5, 14)
    some, word = [draw.choice(things) for _ in range(n)], lambda: draw.choice(names)
    number = lambda: draw.choice([str(draw.randint(1, 99999)), f"{draw.uniform(0, 900):.2f}", f"{draw.randint(1, 99)}%"])
    return draw.choice([
        lambda: "\n".join(draw.choice("-*•") + f" {x}" for x in some),
        lambda: "\n".join(f"{k}. {x}" for k, x in enumerate(some, 1)),
        lambda: "\n".join(some),
        lambda: "\n".join(f"{x}." for x in some),
        lambda: "\n".join(" | ".join([draw.choice(things), number(), number()]) for _ in some),
        lambda: "\n".join(",".join([draw.choice(things), number(), draw.choice(things), number()]) for _ in some),
        lambda: "\n".join(draw.choice([" / ", " » ", " · "]).join(draw.sample(things, 5)) for _ in range(3)),
        lambda: "\n".join(f"{draw.choice(things)}{draw.choice([': ', ' = ', ' ... '])}{draw.choice(things)}" for _ in some),
        lambda: "\n".join(" ".join(f"{draw.randrange(1 << 16):04x}" for _ in range(9)) for _ in range(4)),
        lambda: "\n".join("".join(draw.choice("{}[]()<>|~^;:+*#@!/\\ '`_") for _ in range(30)) for _ in range(4)),
        lambda: "".join(draw.choice(["&#233;", "\\x8f", "%%", "�", word()[:4], "~", draw.choice(things)[:3], "\n"]) for _ in range(50)),
        lambda: "\n".join(f"def {word()}_{word()}({word()}):\n    {word()} = {word()}({draw.randint(1, 99)})\n    return {word()}" for _ in range(3)),
        lambda: "\n".join(f"const {word()} = {word()}.{word()}({draw.randint(1, 99)});\nif ({word()} > {draw.randint(1, 9)}) {{\n  return {word()};\n}}" for _ in range(3)),
        lambda: "\n".join(f"{word()}:\n  {word()}: {number()}\n  {word()}: {word()}" for _ in range(4)),
        lambda: "\n".join(f"[{word()}]\n{word()} = {number()}" for _ in range(4)),
    ])()


def composed(first: bool, many: int) -> list[tuple[str, int]]:
    """``many`` texts of the first or the second half of all fragments, every language alike, half of them prose."""
    draw = random.Random(many + first)
    out = []
    for k in range(many):
        language = list(SENTENCES)[k // 2 % len(SENTENCES)]
        things = _split(THINGS[language], first)
        if k % 2:
            out.append((_prose(draw, _split(SENTENCES[language], first), things, "" if language == "ja" else " "), 1))
        else:
            out.append((_junk(draw, things, _split(NAMES, first)), 0))
    return out


def seeds() -> list[tuple[str, int]]:
    """Texts that join every training sample."""
    return composed(True, 240)


def holdout() -> list[tuple[str, int]]:
    """Texts that are never trained on."""
    return composed(False, 400)
