"""The English (Porter2) stemmer, written from its published description."""

from __future__ import annotations

import re

from millstone.errors import EngineSystemError

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if prefix:
        r1 = len(prefix)
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word[1:] if word[0] == "'" else word
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = ("Y" if w[:1] == "y" else w[:1]) + re.sub(r"(?<=[aeiouy])y", "Y", w)[1:]
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    # 1b
    if w.endswith(("eed", "eedly")):
        s = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    else:
        s = next((x for x in ("ingly", "edly", "ing", "ed") if w.endswith(x)), None)
        if s and any(c in _VOWELS for c in w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif len(w) <= r1 and _short_syllable(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w[-4:-3] == "l") and (s != "li" or w[-3:-2] in tuple(_LI)):
                w = w[: -len(s)] + to
            break
    # 3
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + to
            break
    # 4
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


STEMMERS = {"en": english}


def stemmer(lang: str):
    """The stemming function of a language."""
    if lang not in STEMMERS:
        raise EngineSystemError(f"no stemmer for language '{lang}'")
    return STEMMERS[lang]
