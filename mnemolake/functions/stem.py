"""Tokens of a full-text index: Unicode letters and digits, folded, with suffixes stripped by Porter's 1980 algorithm."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from mnemolake.functions.slices import KNOWN, slices

_VOWEL = "aeiou"
#: The published suffix tables of steps 2, 3 and 4.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWEL or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _consonants(word)))


def _short(word: str) -> bool:
    return _consonants(word)[-3:] == "cvc" and len(word) > 2 and word[-1] not in "wxy"


def stem(word: str) -> str:
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _consonants(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _consonants(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if _measure(word[: -len(end)]) else word
                break
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def fold_tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits without diacritics."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    out, run = [], []
    for c in flat.lower():
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def stems_of(text: str, known: dict[str, str] | None = None) -> list[str]:
    known = {} if known is None else known
    out = []
    for t in fold_tokens(text):
        if t not in known:
            known[t] = stem(t)
        out.append(known[t])
    return out


def _stem_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, str] = {}
    for batch in slices(batches):
        if len(known) > KNOWN:
            known.clear()
        yield pa.array([stems_of(t.as_py() or "", known) for t in batch], type=pa.list_(pa.string()))


def stems(text: Column) -> Column:
    return F.arrow_udf(_stem_batches, from_arrow_type(pa.list_(pa.string())))(text)


def plain_tokens(text: Column) -> Column:
    """ASCII letters and digits, lower-cased, unstemmed; by expressions alone."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
