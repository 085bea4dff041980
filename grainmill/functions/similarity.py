"""Jaro-Winkler similarity and phonetic keys, as helpers inside Arrow functions."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _matches(a: str, b: str, reach: int) -> tuple[int, int]:
    """(characters of one text that the other has near by, how many of them stand in another order)."""
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    right = [y for y, unused in zip(b, free, strict=True) if not unused]
    return len(left), sum(x != y for x, y in zip(left, right, strict=True))


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        n += 1
    return n


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with whole transpositions, plus the prefix bonus above 0.7; both empty: 0."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    m, moved = _matches(a, b, max(max(len(a), len(b)) // 2 - 1, 0))
    if not m:
        return 0.0
    jaro = (m / len(a) + m / len(b) + (m - moved // 2) / m) / 3
    return jaro if jaro <= 0.7 else jaro + 0.1 * _prefix(a, b) * (1 - jaro)


def field_similarity(a: str, b: str) -> float:
    """Percentage for one field, without case: halves of transpositions count, the bonus is always given; both empty: 100."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 100.0
    m, moved = _matches(a, b, max(len(a), len(b)) // 2 - 1) if a and b else (0, 0)
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3 if m else 0.0
    return math.floor((jaro + 0.1 * _prefix(a, b) * (1 - jaro)) * 1000 + 0.5) / 10


@F.pandas_udf(T.DoubleType())
def field_similarity_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([field_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def reachable(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone leave room for a similarity of ``least``; a native filter before the UDF."""
    short, long_ = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    jaro = (2 + short / F.greatest(long_, F.lit(1))) / 3
    return jaro + 0.4 * (1 - jaro) >= least


#: Sounds of letters by what stands around them, the first that fits.  A row: pattern, and the primary
#: and secondary code where they differ.  What the pattern takes is passed over, what it only looks at is not.
SOUNDS = (
    ("^[AEIOUY]", "A"), ("[AEIOUY]", ""),
    ("BB?", "P"),
    ("CH", "X"), ("C(?=[IEY])", "S"), ("C[KC]?", "K"),
    ("DG[IEY]", "J"), ("DG", "TK"), ("D[TD]?", "T"),
    ("FF?", "F"),
    ("(?<=[AEIOU])GH", ""), ("GH", "K"), ("^GN", ""), ("GN", "KN", "N"), ("G[IEY]", "J", "K"), ("GG?", "K"),
    ("(?:^|(?<=[AEIOU]))H(?=[AEIOU])", "H"), ("H", ""),
    ("JJ?", "J"), ("KK?", "K"), ("LL?", "L"), ("MM?", "M"), ("NN?", "N"),
    ("PH", "F"), ("P[PB]?", "P"),
    ("QQ?", "K"), ("RR?", "R"),
    ("SH", "X"), ("SI[OA]", "X", "S"), ("S[SC]?", "S"),
    ("TION", "X"), ("TH", "0", "T"), ("T[TD]?", "T"),
    ("VV?", "F"),
    ("W(?=[AEIOU])", "A"), ("W", ""),
    ("^X", "S"), ("XX?", "KS"),
    ("ZZ?", "S"),
)
#: Beginnings whose first letter is silent.
SILENT = re.compile("GN|KN|PN|WR|PS")
_SOUND = re.compile("|".join(f"({pattern})" for pattern, *_ in SOUNDS))


def phonetic(word: str, size: int = 4) -> tuple[str, str]:
    """Primary and secondary sound codes of the ASCII letters of a value, four signs at most."""
    letters = re.sub("[^A-Z]", "", word.upper())
    one = two = ""
    at = 1 if SILENT.match(letters) else 0
    while at < len(letters) and (len(one) < size or len(two) < size):
        found = _SOUND.match(letters, at)
        _, *codes = SOUNDS[found.lastindex - 1]
        one, two, at = one + codes[0], two + codes[-1], found.end()
    return one[:size], two[:size]


def metaphone_key(value: str) -> str:
    one, two = phonetic(value)
    return one if one == two else f"{one}|{two}"


def token_key(value: str) -> str:
    """Primary codes of all words, sorted."""
    plain = "".join(x for x in unicodedata.normalize("NFD", value.lower()) if not "̀" <= x <= "ͯ")
    words = re.sub(r"[^a-z0-9\s]", "", plain).split()
    return " ".join(sorted(k for k in (phonetic(w)[0] for w in words) if k))


def _each(function):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return F.pandas_udf(run, T.StringType())


metaphone_column = _each(metaphone_key)
token_phonetic_column = _each(token_key)


def register(spark) -> None:
    """SQL names for the functions that Spark has not."""
    spark.udf.register("jaro_winkler", jaro_winkler_column)
    spark.udf.register("double_metaphone", metaphone_column)
    spark.udf.register("token_phonetic", token_phonetic_column)
