"""Stems of English words by Porter's published algorithm (1980): suffixes are
replaced in five steps, each rule under a condition on the stem that remains.
A word is a string of c(onsonants) and v(owels); its measure is the number of
times a vowel is followed by a consonant."""

from __future__ import annotations

import re

# --- fixed values: the algorithm's suffix rules by step, (suffix, replacement)
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# ----------------------------------------------------------------------------
_BY_LENGTH = {step: sorted(rules, key=lambda r: -len(r[0])) for step, rules in
              ((2, STEP_2), (3, STEP_3), (4, tuple((s, "") for s in STEP_4)))}


def _shape(word: str) -> str:
    """c and v for every letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends with consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, step: int, least: int) -> str:
    """The longest suffix of a step that fits, replaced if what remains has at least that measure."""
    for suffix, new in _BY_LENGTH[step]:
        if word.endswith(suffix):
            stem = word[:len(word) - len(suffix)]
            allowed = _measure(stem) >= least and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem + new if allowed else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):  # step 1a
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):  # step 1b
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[:-len(x)] for x in ("ed", "ing") if word.endswith(x) and _has_vowel(word[:-len(x)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif _doubled(cut) and cut[-1] not in "lsz":
                word = cut[:-1]
            else:
                word = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if word.endswith("y") and _has_vowel(word[:-1]):  # step 1c
        word = word[:-1] + "i"
    word = _replaced(word, 2, 1)
    word = _replaced(word, 3, 1)
    word = _replaced(word, 4, 2)
    if word.endswith("e"):  # step 5a
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short_end(word[:-1])) else word
    if word.endswith("ll") and _measure(word) > 1:  # step 5b
        word = word[:-1]
    return word
