"""String similarities that Spark has no built-in for, as Arrow-backed UDFs."""

from __future__ import annotations

import difflib
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


def jaro(a: str, b: str, whole: bool = False) -> float:
    """Jaro similarity; ``whole``: an odd transposition is dropped instead of counted by half."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    left: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = 1
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    swapped = int(swapped) if whole else swapped
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    base = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + same * weight * (1 - base)


def fallback(a: str, b: str) -> float:
    return max(jaro_winkler(a, b), difflib.SequenceMatcher(None, a, b).ratio())


CONFUSED = str.maketrans("il1uvce", "IIIUUCC")


@lru_cache(1 << 16)
def confusion_bigrams(token: str) -> tuple[str, frozenset]:
    """A token with signs that are misread for each other made alike, and its bigrams."""
    alike = token.lower().replace("rn", "m").translate(CONFUSED)
    return alike, frozenset(alike[i : i + 2] for i in range(len(alike) - 1))


def ocr_aware(a: str, b: str) -> float:
    """1 if both are alike but for misread signs, else the Dice share of their bigrams."""
    (one, x), (other, y) = confusion_bigrams(a), confusion_bigrams(b)
    if one == other:
        return 1.0
    return 2.0 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def folded(text: str) -> str:
    """Compatibility forms composed, long s and special spaces folded, bracketed gaps dropped, white space collapsed."""
    text = unicodedata.normalize("NFKC", text or "").replace("ſ", "s")
    for gap in ("[…]", "[...]", "[..]"):
        text = text.replace(gap, " ")
    return " ".join(text.split())


def bare(text: str) -> str:
    """Lower case without diacritics and punctuation."""
    kept = (c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in kept).split())


def _pairs(function):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def _strings(function):
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(function)

    return run


def udfs() -> dict:
    return {"ocr_aware": _pairs(ocr_aware), "jaro": _pairs(jaro), "jaro_whole": _pairs(lambda a, b: jaro(a, b, whole=True)), "jaro_winkler": _pairs(jaro_winkler), "string_similarity": _pairs(fallback), "normalize_unicode": _strings(folded), "normalise_surface": _strings(bare)}


def register(spark) -> None:
    """Give the functions their SQL names in a session."""
    for name, function in udfs().items():
        spark.udf.register(name, function)
