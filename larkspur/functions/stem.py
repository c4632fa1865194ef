"""The Porter stemmer with the usual later extensions, for single lower-case words.

Written from the published algorithm: a word is a sequence of consonant and vowel runs, its measure the number of
vowel-consonant changes, and five steps rewrite suffixes under conditions on the measure of what is left.
"""

from __future__ import annotations

#: Words whose stem no rule gives.
_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

#: The suffixes of steps 2 to 4 with their replacements.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word's letters as ``c`` and ``v``; ``y`` is a vowel after a consonant."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Whether it ends consonant, vowel, consonant (not w, x, y), or is a vowel and a consonant."""
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first rule whose suffix the word has, if what is left has a measure above 0."""
    for suffix, replacement in rules:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            return left + replacement if _measure(left) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        left = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(left):
            break
    else:
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if len(left) > 1 and left[-1] == left[-2] and _shape(left)[-1] == "c":
        return left if left[-1] in "lsz" else left[:-1]
    return left + "e" if _measure(left) == 1 and _short(left) else left


def _final_y(word: str) -> str:
    left = word[:-1]
    return left + "i" if word.endswith("y") and len(left) > 1 and _shape(left)[-1] == "c" else word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-2])
    if word.endswith("logi") and not word.endswith(tuple(s for s, _ in _STEP2)):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, _STEP2)


def _suffix(word: str) -> str:
    for suffix in _STEP4:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            allowed = _measure(left) > 1 and (suffix != "ion" or left[-1:] in ("s", "t"))
            return left if allowed else word
    return word


def _final_e(word: str) -> str:
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    """The stem of a word; words of one or two letters stay as they are."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _double_suffix):
        word = step(word)
    return _final_e(_suffix(_swap(word, _STEP3)))
