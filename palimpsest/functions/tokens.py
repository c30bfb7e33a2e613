"""Rules on the tokens of whole texts, in Python: a verdict is made once for each token and remembered, as texts repeat theirs.

The column functions of :mod:`palimpsest.functions.text` say the same of single
tokens; over exploded tokens they cost many times as much, and shuffles besides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.functions import constants as C
from palimpsest.functions import text as T

#: Remembered tokens in a process, and rows that are worked on at once.
REMEMBERED, ROWS = 1 << 16, 256

SPACES = re.compile(f"{T.SPACE}+")
AT_START = re.compile(f"\\A{T.SPACE}+")
AT_END = re.compile(f"{T.SPACE}+\\Z")
CONSONANTS = "[bcdfghjklmnpqrstvwxyz]"
RARE = re.compile("|".join(C.RARE_BIGRAMS))
DIGIT, FIVE, FOUR = re.compile("[0-9]"), re.compile(CONSONANTS + "{5,}"), re.compile(CONSONANTS + "{4,}")
VOWELS_LATIN = frozenset(C.VOWELS_LATIN)
PLAIN_SIGNS = frozenset("?…[]'-–—.,;:")


def tokens(text: str) -> list[str]:
    return [t for t in SPACES.split(text) if t]


def letters(t: str) -> int:
    return sum(map(str.isalpha, t))


def vowel_ratio(low: str) -> float:
    """Of a token in lower case."""
    n = letters(low)
    return sum(c in VOWELS_LATIN for c in low) / n if n else 0.0


def rounded(x: float, digits: int) -> float:
    """As SQL rounds: halves away from zero, by the decimal digits of the number."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def strip(text: str) -> str:
    return AT_END.sub("", AT_START.sub("", text))


def by_text(docs: DataFrame, schema: str, function: Callable, *columns: str, many: bool = False) -> DataFrame:
    """A row (doc_id and what the function gives of the columns) for every row, or ``many``; texts never meet, so nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    types, names = [to_arrow_type(f.dataType) for f in fields], ["doc_id", *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows = [function(*x) for x in zip(*(part.column(i).to_pylist() for i in range(1, part.num_columns)), strict=True)]
                ids = part.column(0)
                if many:
                    ids = ids.take(pa.array([i for i, x in enumerate(rows) for _ in x], pa.int64()))
                    rows = [y for x in rows for y in x]
                values = zip(*rows, strict=True) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(values, types, strict=True))], names)

    return docs.select("doc_id", *columns).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


# ---- signals of quality -----------------------------------------------------------------------

LINES = re.compile("\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")
RARE_AHEAD, UNLIKELY_BIGRAM = re.compile("(?=" + "|".join(C.RARE_BIGRAMS) + ")"), re.compile("|".join(C.UNLIKELY_BIGRAMS))
FUNCTION_WORDS = frozenset(C.FUNCTION_WORDS)
SIGNALS = "token_count int, long int, bad int, odd int, line_count int, lead long, seam long, trail long, entropy double, rare double, unc double"


def bigram_counts(low: str) -> tuple[int, int]:
    """Rare ones, and neighbouring letters: letters less runs of letters."""
    return len(RARE_AHEAD.findall(low)), sum(a.isalpha() and b.isalpha() for a, b in zip(low, low[1:], strict=False))


def non_wordlike(t: str) -> float:
    """0 for a word, 1 for gibberish (Latin script)."""
    low = t.lower()
    n, alpha, v = len(low), letters(low), vowel_ratio(low)
    if n < 2:
        return 0.5
    run = most = 0
    for c in low:
        run = run + 1 if c.isalpha() and c not in VOWELS_LATIN else 0
        most = max(most, run)
    score = min(0.3, (n - alpha) / n) if alpha else 0.0
    score += 0.30 if v < 0.12 else 0.15 if v < 0.18 else 0.20 if v > 0.80 else 0.0
    score += 0.35 if most >= 5 else 0.15 if most >= 4 else 0.0
    if alpha >= 4:
        rare, pairs = bigram_counts(low)
        score += (rare / pairs if pairs else 0.0) * 0.5
    return min(1.0, score)


@lru_cache(REMEMBERED)
def signs(t: str) -> tuple[bool, bool, bool, int, int, bool, bool, bool]:
    """Of a token: long, unlike a word, doubtful, rare and all bigrams; as the first of a line a fragment, as the last a break or a fragment."""
    low, long = t.lower(), len(t) >= 3
    one = len(t) == 1 and t.isalpha()
    consonant = one and low not in VOWELS_LATIN
    two = len(t) == 2 and t.isalpha() and category(t[0]) != "Lu"
    lead = t[0] in "-–—" or (low not in FUNCTION_WORDS and (consonant or two))
    return long, long and non_wordlike(t) > 0.45, "?" in t or "…" in t or "[" in t, *bigram_counts(low), lead, one or t[-1] == "-", t[-1] == "-" or consonant


def entropy(text: str) -> float:
    """Bits of the distribution of lower-cased characters."""
    n = len(text)
    return 0.0 - sum(k / n * math.log2(k / n) for k in Counter(text.lower()).values())


def signals(text: str) -> tuple:
    """The counts and shares of SIGNALS: tokens, lines, characters, bigrams and marks of doubt."""
    n = long = bad = odd = lines = lead = seam = trail = rare = pairs = 0
    for line in LINES.split(text):
        here = [signs(t) for t in tokens(line)]
        if here:
            for is_long, is_bad, is_odd, some, every, *_ in here:
                long, bad, odd, rare, pairs = long + is_long, bad + is_bad, odd + is_odd, rare + some, pairs + every
            first, last = here[0], here[-1]
            # A lone consonant that is a whole line is no fragment at its end; a dash is.
            end = last[7] and (len(AT_END.sub("", line)) >= 2 or "-" in line)
            n, lines, lead, seam, trail = n + len(here), lines + 1, lead + first[5], seam + (first[5] or last[6]), trail + end
    doubts = text.count("?") + text.count("…") + text.count("[…]") * 3
    return n, long, bad, odd, lines, lead, seam, trail, entropy(text), rare / pairs if pairs else 0.0, doubts / len(text) if text else 0.0


# ---- tokens that two passes read differently ------------------------------------------------------

HYPHENED = re.compile("[^-]+-[^-]+", re.DOTALL)


@lru_cache(REMEMBERED)
def marked_token(t: str) -> str:
    """What becomes of an unstable token: a gap, question marks for its letters, or itself."""
    if HYPHENED.fullmatch(t):
        left, right = t.split("-")
        turned = {category(left[-1]), category(right[0])} == {"Ll", "Lu"}
        if turned + bool(UNLIKELY_BIGRAM.search((left + right).lower())) + (min(len(left), len(right)) <= 2) + 1 >= 3:
            return "[…]"
    score = non_wordlike(t)
    if score > 0.45 and UNLIKELY_BIGRAM.search(t.lower()):
        return "".join("?" if c.isalpha() else c for c in t)
    return "[…]" if score > 0.55 else t


def marked(a: str, b: str) -> tuple[str, int]:
    """Pass ``a`` with its unstable garbage masked, token by token, and how many tokens that changed."""
    old, new = ([tokens(line) for line in x.split("\n")] for x in (a, b))
    unstable = set()
    for i in range(max(len(old), len(new))):
        unstable.update(set(old[i] if i < len(old) else ()) ^ set(new[i] if i < len(new) else ()))
    changed = {t: m for t in unstable if (m := marked_token(t)) != t}
    return "\n".join(" ".join(changed.get(t, t) for t in line) for line in old), sum(t in changed for line in old for t in line)


# ---- marks of doubt that are forced on noisy texts ------------------------------------------

# Improbable bigrams, Roman and year-like tokens (ASCII letters only are folded, as in Java).
IMPROBABLE = ["qj", "vvv", "iii", "kk", "iiit", "xq", "jq", "zx", "qx"]
ROMAN, YEAR_LIKE = re.compile("(?ai)[MDCLXVI]{2,}"), re.compile("(?ai)anno|an|m[cdxlvi]+")
UNLIKELY, TRIPLED = re.compile("|".join(IMPROBABLE)), re.compile(r"(.)\1{2,}", re.DOTALL)


def suspicious(t: str, low: str, n: int, ratio: float) -> bool:
    if not n:
        return False
    roman = ROMAN.fullmatch(t)
    digit = DIGIT.search(t) and not roman and not YEAR_LIKE.fullmatch(t) and not ROMAN.fullmatch("".join(filter(str.isalpha, t)))
    odd = n >= 3 and (UNLIKELY.search(low) or (TRIPLED.search(low) and not roman))
    return bool(digit or (n >= 12 and ratio < 0.20) or odd or (FIVE.search(low) and not roman))


@lru_cache(REMEMBERED)
def doubt(t: str) -> tuple[bool, bool, bool, float]:
    """Whether a token is odd, is junk, or shows doubt, and how much it asks for a mark."""
    low, n, size = t.lower(), letters(t), len(t)
    ratio = vowel_ratio(low)
    odd = (n >= 10 and ratio < 0.20) or (n > 0 and bool(FIVE.search(low) or RARE.search(low)))
    junk = size >= 2 and (size - n - sum(c in PLAIN_SIGNS for c in t)) / size > 0.40
    score = 0.0
    if t not in ("[…]", "?"):
        score = (1.0 if suspicious(t, low, n, ratio) else 0.0) + (0.5 if n >= 6 and ratio < 0.25 else 0.0) + (0.3 if n >= 3 and FOUR.search(low) else 0.0)
    return odd, junk, "?" in t or t == "[…]", score


def forced_marks(text: str) -> tuple[str, int]:
    """A text with a question mark behind its one to three most suspicious tokens if it is noisy and shows no doubt, and how many were set."""
    lines = text.split("\n")
    n = odd = junk = marks = 0
    ranked = []
    for line, old in enumerate(lines):
        for pos, t in enumerate(tokens(old)):
            is_odd, is_junk, mark, score = doubt(t)
            n, odd, junk, marks = n + 1, odd + is_odd, junk + is_junk, marks + mark
            if score > 0:
                ranked.append((-score, line, pos))
    share = lambda k: rounded(k / n, 6) if n else 0.0
    if share(marks) > 0 or (share(odd) <= 0.05 and share(junk) <= 0.03):
        return text, 0
    if not ranked:
        lines[-1] = AT_END.sub("", lines[-1]) + " [?]"
        return "\n".join(lines), 1
    chosen = sorted(ranked)[: min(max(1, int(len(ranked) * 0.10)), 3)]
    for line in {x[1] for x in chosen}:
        here = {x[2] for x in chosen if x[1] == line}
        lines[line] = " ".join(t + "?" if pos in here else t for pos, t in enumerate(tokens(lines[line])))
    return "\n".join(lines), len(chosen)
