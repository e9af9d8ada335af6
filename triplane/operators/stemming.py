"""The Snowball stemmer for English, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL, _SHORT = "aeiouy", re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again within R1."""

    def after(start: int) -> int:
        m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
        return m.end() if m else len(word)

    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else after(0)
    return r1, after(r1)


def _ending(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


@lru_cache(1 << 16)
def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _DONE:
        return word
    # Past and gerund.
    end = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    # Suffixes, longest first; each only within its region.
    end = _ending(word, _SECOND)
    if end and len(word) - len(end) >= r1 and not (end == "ogi" and word[-4:-3] != "l") and not (end == "li" and word[-3:-2] not in tuple("cdeghkmnrt")):
        word = word[: -len(end)] + _SECOND[end]
    end = _ending(word, _THIRD)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _THIRD[end]
    end = _ending(word, _FOURTH)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT.search(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
