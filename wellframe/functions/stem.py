"""English words cut to their stems, after the published description of the Snowball English stemmer (Porter, 2001)."""

from __future__ import annotations

import re
from functools import lru_cache

# Words that no index holds.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Endings and what takes their place, tried longest first.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, twice."""
    special = re.match("gener|commun|arsen", word)
    first = special or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]) else w


def _present(w: str, r1: int) -> str:
    """Without eed, ed, ing and the like; what is left gets its e back or loses a double letter."""
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = w[: len(w) - len(e)]
    if e.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not e or not _VOWEL.search(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if _SHORT_END.search(base) and r1 >= len(base) else base


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or not word.isascii() or word in WHOLE:
        return WHOLE.get(word, word)
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(w)
    w = _singular(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _present(w, r1)
    if re.search("[^aeiouy][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    e = _ending(w, STEP_2)
    base = w[: len(w) - len(e)]
    if e and len(base) >= r1 and (e != "ogi" or base.endswith("l")) and (e != "li" or re.search("[cdeghkmnrt]$", base)):
        w = base + STEP_2[e]
    e = _ending(w, STEP_3)
    base = w[: len(w) - len(e)]
    if e and len(base) >= (r2 if e == "ative" else r1):
        w = base + STEP_3[e]
    e = _ending(w, STEP_4)
    base = w[: len(w) - len(e)]
    if e and len(base) >= r2 and (e != "ion" or base.endswith(("s", "t"))):
        w = base
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()
