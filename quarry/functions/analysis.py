"""Analysers of the full-text index: a text to its terms, in order.

plain: lower-cased runs of letters and digits, in the JVM. porter: the same without diacritics and with English words stemmed by
the algorithm that Porter published in 1980, as a Pandas UDF. A worker process stems a word once for all its tasks, as long as its store
of stems has room."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

TERM = r"[\p{L}\p{N}]+"


def plain_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


# The suffixes of the algorithm's steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c+", shape(stem)))


def short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((s for s in ("eed", "ed", "ing") if w.endswith(s)), "")
    if cut == "eed":
        w = w[:-1] if measure(w[:-3]) else w
    elif cut and "v" in shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and short_end(w):
            w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        s = longest(w, table)
        if s and measure(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = longest(w, STEP4)
    if s and measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def terms_of(text: str, known: dict[str, str]) -> list[str]:
    out = []
    for w in re.findall(r"[^\W_]+", fold(text)):
        if w not in known:
            if len(known) > 500_000:
                known.clear()
            known[w] = stem(w)
        out.append(known[w])
    return out


#: Of a worker process, which keeps it from task to task.
_STEMS: dict[str, str] = {}


def known_terms_of(text: str) -> list[str]:
    return terms_of(text, _STEMS)


def porter_terms(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def analyse(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else known_terms_of(t) for t in texts], dtype=object)

    return analyse(text)


ANALYSERS = {"plain": plain_terms, "porter": porter_terms}
#: What the driver does with a word of a query.
QUERY_ANALYSERS = {"plain": lambda t: re.findall(r"[^\W_]+", t.lower()), "porter": lambda t: terms_of(t, {})}
