"""English stems (Porter, 1980) and the terms that a full-text index holds."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English words that an index leaves out.
ENGLISH_STOP_WORDS = set(
    """a about above after again against all am an and any are as at be because been before being below between both but
    by can did do does doing don down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then
    there these they this those through to too under until up very was we were what when where which while who whom why
    will with you your yours yourself yourselves""".split()
)

#: The published suffix rules of steps 2, 3 and 4.
STEP2 = "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple((x.strip() + " ").split(" ")[:2]) for x in text.split(", ")]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TWO, _THREE = _rules(STEP2), _rules(STEP3)
_FOUR = sorted(STEP4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, to in rules:
        if word.endswith(end):
            head = word[: -len(end)]
            return head + to if _measure(head) > least else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        double = len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz"
        if cut.endswith(("at", "bl", "iz")) or (_measure(cut) == 1 and _short(cut)):
            cut += "e"
        word = cut[:-1] if double else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _TWO, 0), _THREE, 0)
    for end in _FOUR:
        if word.endswith(end):
            head = word[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                word = head
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def english_terms(text: Column) -> Column:
    """Stems of a text's words without stop words, in order with repeats.  Words
    are found in the JVM; only stemming runs in Python, once for each distinct
    word of an Arrow batch."""
    from .text import word_tokens

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stems(words: pd.Series) -> pd.Series:
        distinct = {w for ws in words if ws is not None for w in ws}
        known = {w: stem(w) for w in distinct if w not in ENGLISH_STOP_WORDS}
        return words.map(lambda ws: [known[w] for w in ws if w in known] if ws is not None else [])

    return stems(word_tokens(text))
