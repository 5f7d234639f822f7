"""English analysis for lexical indexes: structured tokens, stop words, stems.

Tokens keep structures that a split at punctuation would break: signed, decimal, dotted and
scientific numbers, serials with slashes, versions, and hyphenated words, which give the whole
and its parts. Anything with a digit is never stemmed.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.functions.text import STOP_WORDS

_WORD, _LETTER, _DIGIT = r"[^\W_]", r"[^\W_0-9]", "[0-9]"
_EXP = rf"[eE][+-]?{_DIGIT}+(?!{_WORD})"
_NUMBER = rf"{_DIGIT}+(?:\.{_DIGIT}+)*(?:{_EXP})?"
#: Kinds of tokens; the first that fits at a place is taken.
_TOKEN = re.compile(
    "|".join(
        (
            rf"[+-]{_NUMBER}",
            rf"{_DIGIT}+(?:/{_DIGIT}{_WORD}*)+",
            rf"{_DIGIT}+(?!{_EXP}){_LETTER}{_WORD}*",
            _NUMBER,
            rf"(?P<compound>{_LETTER}+(?:-{_LETTER}+(?!{_WORD}))+)",
            rf"{_LETTER}+{_DIGIT}{_WORD}*(?:\.{_WORD}+)*",
            rf"{_LETTER}+",
        )
    )
)


def tokens(text: str) -> list[str]:
    """Tokens in order, case as it is."""
    out = []
    for m in _TOKEN.finditer(text):
        out.append(m[0])
        if m["compound"]:
            out += m[0].split("-")
    return out


_VOWELS = "aeiouy"
_STOP = frozenset(STOP_WORDS)
# Fixed values of the published English stemmer.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        r1 = after(0)
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """The published second English stemmer of Porter, on one lower-cased word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _VOWELS):
            chars[i] = "Y"
    w = "".join(chars)
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
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w.replace("Y", "y")
    # 1b
    if w.endswith(("eed", "eedly")):
        n = 3 if w.endswith("eed") else 5
        if len(w) - n >= r1:
            w = w[:-n] + "ee"
    else:
        s = next((s for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), None)
        if s and any(c in _VOWELS for c in w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    # 2
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                before = w[: -len(s)]
                if (s != "ogi" or before.endswith("l")) and (s != "li" or before.endswith(tuple("cdeghkmnrt"))):
                    w = before + to
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
            if len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def analyze(text: str, stemming: bool = True) -> list[str]:
    """Lexemes of a text: no stop words, nothing above 255 bytes."""
    out = []
    for t in tokens(text):
        if len(t.encode()) > 255:
            continue
        t = t.lower()
        if t in _STOP:
            continue
        out.append(stem(t) if stemming and t.isascii() and not any(c.isdigit() for c in t) else t)
    return out


@F.pandas_udf(ArrayType(StringType()))
def english_lexemes(texts: pd.Series) -> pd.Series:
    return pd.Series([analyze(t or "") for t in texts])


@F.pandas_udf(ArrayType(StringType()))
def structured_tokens(texts: pd.Series) -> pd.Series:
    return pd.Series([tokens(t or "") for t in texts])
