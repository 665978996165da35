"""The Porter stemmer as full-text indexes apply it: to lower-case tokens of 3 to 64 bytes, byte by byte.

Runs once for each distinct token, in Arrow batches; the tokens' rows are joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the published algorithm (M. F. Porter, 1980, with its later changes).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

VOWELS = "aeiou"


def _shape(word: str) -> str:
    """v or c for each byte: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in VOWELS or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _by_suffix(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem_word(word: str) -> str:
    raw = word.encode()
    if not 3 <= len(raw) <= 64:
        return word
    w = raw.decode("latin-1")  # a byte is a letter; those beyond ASCII are consonants
    if w.endswith(("sses", "ies")) and w not in ("sses", "ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and w != "eed":
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if "v" in _shape(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-1:] == w[-2:-1] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _ends_cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _by_suffix(w, STEP2, 0)
    w = _by_suffix(w, STEP3, 0)
    if not w.endswith("ion") or w[-4:-3] in ("s", "t"):
        w = _by_suffix(w, dict.fromkeys(STEP4, ""), 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode("utf-8", "ignore")


def _stem_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for tokens in batches:
        yield tokens.map(lambda t: None if t is None else stem_word(t))


def stems(token: Column) -> Column:
    """Stems of lower-case tokens; meant for distinct tokens."""
    return pandas_udf(_stem_batches, StringType())(token)
