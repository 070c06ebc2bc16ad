"""Invented prose, for fixtures and tests."""

import random

LETTERS = {"en": "the of and to in is that it was for on with as by at from this".split(), "fr": "le la les des une dans est pour que qui sur avec plus par ce il".split(), "de": "der die und das ist nicht ein eine mit auf für von dem sich auch".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    """Common words of a language among words made of its syllables."""
    syllables = {"en": "th er ing ion ess wh ould ly", "fr": "eau oux ment eur aîn ais é", "de": "sch ung keit lich ß ä pf"}[lang].split()
    return " ".join(rng.choice(LETTERS[lang]) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(n))
