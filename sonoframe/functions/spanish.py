"""Spanish words: accents, syllables and stress."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = set("aeiouáéíóúü")
STRONG, ACCENTED_WEAK, ACCENTED = set("aeoáéó"), set("íú"), set("áéíóú")
#: Pairs of consonants that begin a syllable together.
ONSETS = {a + b for a in "pbcgf" for b in "lr"} | {"tr", "dr"}


def without_accents(word: Column) -> Column:
    """The word decomposed (NFD) and without marks; ñ stays. Words of the Spanish alphabet need no Python."""
    plain = F.translate(word, "áéíóúüÁÉÍÓÚÜ", "aeiouuAEIOUU")
    return F.when(plain.rlike(r"^[\x00-\x7FñÑ]*$"), plain).otherwise(unmarked(word))


@F.pandas_udf(T.StringType())
def unmarked(words: pd.Series) -> pd.Series:
    def one(word):
        held = unicodedata.normalize("NFC", word).replace("ñ", "\0").replace("Ñ", "\1")
        bare = "".join(c for c in unicodedata.normalize("NFD", held) if unicodedata.category(c) != "Mn")
        return bare.replace("\0", "ñ").replace("\1", "Ñ")

    return words.map(lambda w: None if w is None else one(w))


def vos_form(word: Column) -> Column:
    """Whether a verb looks like a present form of "vos"."""
    w = F.lower(word)
    return (w == "sos") | ((F.length(w) >= 4) & w.rlike("(ás|és|ís)$"))


def sounds(word: str) -> list[str]:
    """Letters, with digraphs as one: ch, ll, rr, qu before a vowel, gu before e and i."""
    out, i = [], 0
    word = unicodedata.normalize("NFC", word.lower())
    while i < len(word):
        pair, after = word[i : i + 2], word[i + 2 : i + 3]
        joined = pair in ("ch", "ll", "rr") or (pair == "qu" and after and after in VOWELS) or (pair == "gu" and after and after in "ei")
        out.append(pair if joined else word[i])
        i += len(out[-1])
    return out


def hiatus(a: str, b: str) -> bool:
    """Whether two vowels in a row belong to two syllables: both strong, or one strong and the other weak with an accent."""
    return a in STRONG and (b in STRONG or b in ACCENTED_WEAK) or b in STRONG and a in ACCENTED_WEAK


def syllables(word: str) -> list[str]:
    """The syllables of a word: nuclei of vowels, consonants before them as far as they begin a syllable."""
    parts = sounds(word)
    nuclei: list[list[int]] = []
    for i, sound in enumerate(parts):
        if sound not in VOWELS:  # y counts as a consonant throughout
            continue
        if nuclei and nuclei[-1][-1] == i - 1 and not hiatus(parts[i - 1], sound):
            nuclei[-1].append(i)
        else:
            nuclei.append([i])
    if not nuclei:
        return [word] if word else []
    starts = [0]
    for left, right in zip(nuclei, nuclei[1:], strict=False):
        between = right[0] - left[-1] - 1
        if between <= 1:
            starts.append(right[0] - between)
        else:
            pair = parts[right[0] - 2] + parts[right[0] - 1]
            starts.append(right[0] - (2 if pair in ONSETS else 1))
    return ["".join(parts[a:b]) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)]


def stressed(parts: list[str]) -> int:
    """Place of the stressed syllable: an accent, else the last but one after a vowel, n or s, else the last."""
    for i, part in enumerate(parts):
        if set(part) & ACCENTED:
            return i
    if len(parts) < 2:
        return 0
    return len(parts) - 2 if parts[-1][-1] in "aeiouns" else len(parts) - 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def syllabify(words: pd.Series) -> pd.Series:
    """Syllables of each word; none of a null or empty one."""
    return words.map(lambda w: syllables(w) if w else [])


def expected_stress(parts: Column) -> Column:
    """The same rule as :func:`stressed` over an array column of syllables."""
    marked = F.array_position(F.transform(parts, lambda p: p.rlike("[áéíóú]")), True).cast("int") - 1
    open_end = F.element_at(parts, -1).rlike("[aeiouns]$")
    n = F.size(parts)
    return F.when(marked >= 0, marked).when(n < 2, F.when(n == 1, 0)).when(open_end, n - 2).otherwise(n - 1)
