"""The Snowball project's English stemmer ("Porter 2"), after its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the definition: words with stems of their own, words that stay as they are, from the start and after the
#: first step; beginnings after which the first region begins; double letters; letters before a removable -li.
OWN_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
SETTLED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
#: Endings of the second, third and fourth step and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]

VOWEL, NOT_VOWEL = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{VOWEL}{NOT_VOWEL}")
SHORT_END = re.compile(f"(?:^{VOWEL}{NOT_VOWEL}|{NOT_VOWEL}{VOWEL}[^aeiouywxY])$")


def regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: behind the first consonant after a vowel, and behind the next such one."""

    def behind(start: int) -> int:
        found = REGION.search(word, start)
        return found.end() if found else len(word)

    first = next((len(b) for b in BEGINNINGS if word.startswith(b)), None)
    first = behind(0) if first is None else first
    return first, behind(first)


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def english_stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    w = re.sub(f"(^|{VOWEL})y", r"\1Y", word.removeprefix("'"))
    r1, r2 = regions(w)
    w = w.removesuffix("'").removesuffix("'s")

    ending = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        w = w[:-2]
    elif ending in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif ending == "s" and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in SETTLED:
        return w

    ending = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        w = w[: -len(ending)] + "ee" if len(w) - len(ending) >= r1 else w
    elif ending and re.search(VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and SHORT_END.search(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and re.match(NOT_VOWEL, w[-2]):
        w = w[:-1] + "i"

    ending = longest(w, SECOND)
    if ending and len(w) - len(ending) >= r1:
        before = w[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l") or ending == "li" and before[-1:] not in BEFORE_LI):
            w = before + SECOND[ending]

    ending = longest(w, THIRD)
    if ending and len(w) - len(ending) >= (r2 if ending == "ative" else r1):
        w = w[: -len(ending)] + THIRD[ending]

    ending = longest(w, FOURTH)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]

    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not SHORT_END.search(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.lower()


def stem(word: Column) -> Column:
    """``english_stem`` of words; a worker works each word out once."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else english_stem(w))

    return stems(word)
