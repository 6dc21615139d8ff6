"""Small corpora with the awkward cases: nulls, empty and long texts, copies, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = {
    "en": "the and of to in that it was for on with as his they at be this from have by hot word but what some".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch nach straße über".split(),
    "fr": "le la les et des en un une du que est pour qui dans ce il sur ne se pas plus par très élève où".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, score double, spans string, lang_pred string, bits long"


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    made: list[tuple] = []
    shared = [rng.choice(WORDS["en"]) + str(rng.randrange(50)) for _ in range(130)]

    def add(text, lang="en", doc_id=None):
        made.append((len(made) if doc_id is None else doc_id, text, lang, "s", 0.5, "x", "y", 7))

    for lang, words in WORDS.items():
        for _ in range(12):
            add(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 260))), lang)
    for cut in (49, 50, 51, 75, 100, 130):  # a shared passage, at all alignments, around the window's length
        front = [rng.choice(WORDS["de"]) + "q" * rng.randrange(3) for _ in range(rng.randrange(60))]
        add("\t".join(front + shared[130 - cut:]) + "\n end %d" % cut, "de")
    long_ = " ".join(rng.choice(WORDS["fr"]) + str(rng.randrange(9)) for _ in range(30_000))
    add(long_, "fr")
    add(long_ + " tail", "fr")
    add(long_, "fr")
    near = [rng.choice(WORDS["en"]) + str(rng.randrange(200)) for _ in range(300)]
    for i in range(8):
        add(" ".join(near[:150] + [f"x{i}"] + near[151:]))
    add("again and " * 200)  # repeats itself
    for text in ("", None, " \t\n", "12 34 !!", "one", "a b  c \x1c d", "Ünïcode ÉCOLE Straße's  don't co-op ×÷ Ωσς İ", "\U0001F600 漢字 <|endoftext|> x", "▁mark ▁"):
        add(text, None if text is None else "en")
    add("passage " * 60, None)
    made.append(made[3])  # a repeated row
    made.append((None, " ".join(shared), "en", "s", 0.5, "x", "y", 7))
    made.append((None, None, None, None, None, None, None, None))
    return made


def documents(spark, seed: int = 1, parts: int = 5):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(parts)
