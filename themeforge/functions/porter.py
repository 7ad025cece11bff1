"""Porter's suffix-stripping algorithm (Program 14(3), 1980) with the usual later amendments.

The amendments (short words kept, ``y`` after a consonant, ``ies``/``ied`` of
four-letter words, ``fulli``, ``logi``, a short list of irregular forms) are on
by default and can be switched off to get the rules of the 1980 paper.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffix rules of the paper, step 2, step 3 and step 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# Irregular forms of the amended algorithm, stem and its words.
_IRREGULAR = {
    "sky": ("sky", "skies"), "die": ("dying",), "lie": ("lying",), "tie": ("tying",),
    "news": ("news",), "inning": ("innings", "inning"), "outing": ("outings", "outing"),
    "canning": ("cannings", "canning"), "howe": ("howe",), "proceed": ("proceed",),
    "exceed": ("exceed",), "succeed": ("succeed",),
}
_IRREGULAR_WORDS = {word: stem for stem, forms in _IRREGULAR.items() for word in forms}


def _shape(word: str) -> str:
    """One letter per character: ``v`` for a vowel, ``c`` for a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str, amended: bool) -> bool:
    shape = _shape(word)
    if amended and shape == "vc":
        return True
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes):
    hits = [s for s in suffixes if word.endswith(s)]
    return max(hits, key=len) if hits else None


def _plural(word: str, amended: bool) -> str:
    if amended and word.endswith("ies") and len(word) == 4:
        return word[:-1]
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past_or_gerund(word: str, amended: bool) -> str:
    if amended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
            stem = word[: -len(suffix)]
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _cvc(stem, amended):
        return stem + "e"
    return stem


def _final_y(word: str, amended: bool) -> str:
    if not word.endswith("y"):
        return word
    stem = word[:-1]
    applies = (len(stem) > 1 and _shape(stem)[-1] == "c") if amended else _has_vowel(stem)
    return stem + "i" if applies else word


def _swap(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    return stem + rules[suffix] if _measure(stem) > 0 else word


def _second(word: str, amended: bool) -> str:
    rules = dict(_STEP2)
    if amended:
        if word.endswith("alli") and _measure(word[:-4]) > 0:
            return _second(word[:-2], amended)
        rules.update({"fulli": "ful", "bli": "ble"})
        rules.pop("abli")
        if word.endswith("logi"):
            return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, rules)


def _fourth(word: str) -> str:
    suffix = _longest(word, _STEP4)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) <= 1 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _fifth(word: str, amended: bool) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem, amended)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def porter_stem(word: str, amended: bool = True) -> str:
    """The stem of one lower-case word."""
    if amended:
        if word in _IRREGULAR_WORDS:
            return _IRREGULAR_WORDS[word]
        if len(word) <= 2:
            return word
    word = _plural(word, amended)
    word = _past_or_gerund(word, amended)
    word = _final_y(word, amended)
    word = _second(word, amended)
    word = _swap(word, dict(_STEP3))
    word = _fourth(word)
    return _fifth(word, amended)


@F.pandas_udf(StringType())
def _stem_batch(tokens: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(tokens)
    stems = pd.Series([porter_stem(t) for t in distinct] + [None], dtype=object)
    return stems.take(codes).reset_index(drop=True)


def stem(token: Column | str) -> Column:
    """Stem a token column; each Arrow batch stems its distinct tokens once."""
    return _stem_batch(token)
