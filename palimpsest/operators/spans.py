"""Mentions of whole texts, text by text in Python: what the extractors of :mod:`palimpsest.operators.extraction` find, without a shuffle.

A mention is (start, end, surface, type, confidence, method) with code-point offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from unicodedata import category

from pyspark.sql import DataFrame

from palimpsest.functions import constants as C
from palimpsest.functions import tokens as K
from palimpsest.operators import extraction as X
from palimpsest.operators.passes import bit_distance

SCHEMA = "start_offset int, end_offset int, surface string, ent_type string, confidence double, method string"


def compiled(pattern: str, flags: str = "") -> re.Pattern:
    r"""A Java pattern: ``\s`` and folded case are of ASCII there, letters and numbers at an edge are not."""
    return re.compile(flags + pattern.replace(X.EDGE[0], r"(?u:(?<!\w))").replace(X.EDGE[1], r"(?u:(?!\w))").removeprefix("(?i)"), re.ASCII | (re.IGNORECASE if pattern.startswith("(?i)") else 0))


WORD = re.compile(r"\w+")
TOKEN, RECALL_TOKEN, SALVAGE_TOKEN = (re.compile(p) for p in (X.TOKEN, X.RECALL_TOKEN, X.SALVAGE_TOKEN))
ROMAN, JOINED, NAMES, LINKED = compiled(X.ROMAN), re.compile(X.JOINED.removeprefix("^").removesuffix("\\z")), re.compile(X.sequence_pattern()), re.compile("(?:-N)*-[PB]")
DATES = [compiled("(?i)" + X.EDGE[0] + p) for p in X.DATE_PATTERNS]
DATE_FORMULA, NUMBER, ROMAN_YEAR = compiled(X.DATE_FORMULA), compiled(X.NUMBER), compiled(X.ROMAN_YEAR)
DATE_WORD, DATE_WORDS = re.compile("[A-Za-zÀ-ÿ'’]+"), frozenset([*C.DATE_ANCHORS, *C.MONTHS])
PREPOSITION = compiled(f"(?i){X.EDGE[0]}{X.PLACE_PREPOSITION}")
FIRST_WORDS = ("la ", "le ", "l'", "l’")
PARTICLES, PREFIXES, PLACES, TITLES = (frozenset(x) for x in (X.PARTICLES, X.PREFIXES, C.PLACE_ANCHORS, C.TITLE_ANCHORS))
KINDS = {w: kind for kind in ("place", "person") for w in X.TRIGGERS[kind]}
SALVAGE_TRIGGERS, STOPWORDS, COMMON = frozenset(X.SALVAGE_TRIGGERS), frozenset(X.SALVAGE_STOPWORDS), frozenset(C.COMMON_WORDS)
NO_PART = STOPWORDS | SALVAGE_TRIGGERS
PAUSE, EDITORIAL, WEAK_PLACES = re.compile("[.;:!?]"), frozenset(X.EDITORIAL), frozenset(X.WEAK_PLACES)
VOWELS, NO_VOWELS = frozenset(C.VOWELS), re.compile(f"[^{C.VOWELS}]{{4,}}")


def capital(t: str) -> bool:
    return category(t[0]) == "Lu"


def persons(text: str) -> list[tuple]:
    """Two to five capitalised names in a row on one line, particles between them allowed."""
    found, signs, behind = [], [], 0
    for m in TOKEN.finditer(text):
        t = m.group()
        particle, name = t.lower() in PARTICLES, capital(t) and not ROMAN.search(t)
        signs.append(("-" if JOINED.fullmatch(text, behind, m.start()) else "|") + ("B" if name and particle else "N" if name else "P" if particle else "x"))
        behind = m.end()
        found.append(m.span())
    row, out = "".join(signs), []
    for m in NAMES.finditer(row):
        start, end = found[(m.start() - 1) // 2][0], found[(m.end() - 2) // 2][1]
        sure = 0.65 + min(0.15, 0.05 * (m.group().count("N") + m.group().startswith("B") - 2))
        if LINKED.match(row[m.start() + 1 : m.start() + 1 + 2 * X.REACH]):
            sure = min(0.85, sure + 0.05)
        out.append((start, end, text[start:end], "person", K.rounded(sure, 4), "rule:proper_name_sequence"))
    return out


def dated(span: str) -> bool:
    return bool(DATE_FORMULA.search(span) or NUMBER.search(span) or ROMAN_YEAR.search(span)) or not DATE_WORDS.isdisjoint(DATE_WORD.findall(span.lower()))


def anchors(text: str) -> list[tuple]:
    """Known places and titles, dated spans, and a first line that starts with an article."""
    out = []
    for m in WORD.finditer(text):
        low = m.group().lower()
        if low in PLACES:
            out.append((*m.span(), m.group(), "place", 0.84, "rule:toponym_anchor"))
        elif low in TITLES:
            out.append((*m.span(), m.group(), "title", 0.64, "rule:title_anchor"))
    for pattern in DATES:
        for m in pattern.finditer(text):
            span, parts = m.group(), m.group().split("\n")
            if dated(span) and (len(parts) == 1 or DATE_FORMULA.search(span) or (dated(parts[0]) and dated(parts[-1]))):
                out.append((*m.span(), span, "date", 0.72, "rule:date_pattern"))
    first = next((x for x in map(K.strip, text.split("\n")) if x), "")
    if len(first) <= 80 and first.lower().startswith(FIRST_WORDS) and len(K.tokens(first)) >= 2:
        start = text.find(first)
        out.append((start, start + len(first), first, "work", 0.56, "rule:first_line_title_heuristic"))
    return out


def high_recall(text: str) -> list[tuple]:
    """Tokens after a trigger, longer capitalised tokens, and prefix plus token."""
    found, out = [(m.start(), m.end(), m.group()) for m in RECALL_TOKEN.finditer(text)], []
    for i, (start, end, t) in enumerate(found):
        low = t.lower()
        if i + 1 < len(found):
            from_, to, word = found[i + 1]
            if (kind := KINDS.get(low)) and len(word) >= 3:
                if i + 2 < len(found) and found[i + 2][0] - to <= 2 and (len(found[i + 2][2]) >= 4 or found[i + 2][2].lower() in PREFIXES):
                    to = found[i + 2][1]
                out.append((from_, to, text[from_:to], kind, 0.35, "high_recall:trigger"))
            if low in PREFIXES and len(word) >= 4:
                out.append((start, found[i + 1][1], text[start : found[i + 1][1]], "person", 0.30, "high_recall:name_prefix"))
        if len(t) >= 5 and capital(t):
            out.append((start, end, t, "person", 0.25, "high_recall:capitalized"))
    return out


# ---- salvage ----------------------------------------------------------------------------------


def bigrams(t: str) -> set[str]:
    return {t[i : i + 2] for i in range(len(t) - 1)}


def overlap(a: str, b: str) -> float:
    x, y = bigrams(a.lower()), bigrams(b.lower())
    return 2.0 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def distance(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return bit_distance(a, b) / longest if longest else 0.0


@lru_cache(K.REMEMBERED)
def medieval_name(t: str, known: tuple[str, ...]) -> bool:
    """A known name, or a token of 3 to 18 letters with fair vowels, no four consonants, and not far from a known name if it is longer."""
    n = len(t)
    if not 3 <= n <= 18 or t in COMMON:
        return False
    far = [distance(t, x) for x in known]
    if min(far) == 0.0 if n < 5 else any(d <= 0.25 and overlap(t, x) >= 0.40 for d, x in zip(far, known, strict=True)):
        return True
    return 0.20 <= sum(c in VOWELS for c in t.lower()) / n <= 0.80 and not NO_VOWELS.search(t) and (n < 5 or min(far) <= 0.35)


WORK_BIGRAMS = [(x, bigrams(x)) for x in X.SALVAGE_WORKS]


@lru_cache(K.REMEMBERED)
def work(low: str) -> float | None:
    """Distance of a token to the first known work that it is near."""
    if len(low) < 4 or low in COMMON:
        return None
    mine = bigrams(low)
    for x, his in WORK_BIGRAMS:
        # Shared bigrams rule most pairs out before a distance is computed.
        if low == x or (len(low) >= 5 and 2.0 * len(mine & his) / (len(mine) + len(his)) >= 0.40 and distance(low, x) <= 0.25):
            return distance(low, x)
    return None


@lru_cache(K.REMEMBERED)
def token_quality(t: str) -> float:
    """0.50, moved by length, vowel share, consonant runs and letters; clamped to 0..1, three digits."""
    n = len(t)
    if n < 2:
        return 0.0
    low = t.lower()
    v, run, most = sum(c in VOWELS for c in low) / n, 0, 0
    for c in low:
        run = run + 1 if c.isalpha() and c not in VOWELS else 0
        most = max(most, run)
    score = 0.50 + (0.15 if 3 <= n <= 20 else -0.20 if n < 3 else -0.10)
    score += 0.20 if 0.25 <= v <= 0.65 else 0.05 if 0.15 <= v <= 0.80 else -0.25
    score += -0.35 if most >= 4 else -0.05 if most == 3 else 0.0
    score += 0.10 if K.letters(t) == n else -0.15
    return K.rounded(min(max(score, 0.0), 1.0), 3)


def place_reason(t: str) -> str | None:
    """What speaks against a token behind a preposition of place."""
    low = t.lower()
    if low in EDITORIAL:
        return "editorial_blacklist"
    if low in WEAK_PLACES:
        return "weak_place_lexical_blacklist"
    if len(t) < 5 or low in STOPWORDS:
        return "too_short_or_stopword"
    if low in PLACES:
        return None
    unlike = token_quality(low) < 0.40 if capital(t) else len(t) < 6 or token_quality(low) < 0.50
    return "place_likeness" if unlike else None


def behind_prepositions(text: str, found: list[tuple]) -> list[tuple]:
    """Of the tokens those that begin at most two signs behind a preposition of place."""
    starts = {x[0]: x for x in found}
    ends = (m.end() for m in PREPOSITION.finditer(text))
    return sorted({x for end in ends if (x := starts.get(end) or starts.get(end + 1) or starts.get(end + 2))})


def salvaged(text: str, known: tuple[str, ...]) -> list[tuple]:
    """Mentions of lower-case texts: names behind triggers, works, places; a span counts once, by the first rule that has it."""
    found, out, works = [(m.start(), m.end(), m.group()) for m in SALVAGE_TOKEN.finditer(text)], [], set()
    for i, (start, end, t) in enumerate(found):
        low = t.lower()
        if low in SALVAGE_TRIGGERS:
            parts, to = [], end
            for from_, behind, word in found[i + 1 : i + 1 + X.PARTS]:
                if from_ - to > 3 or PAUSE.search(text, to, from_) or len(word) < 2 or word.lower() in NO_PART:
                    break
                parts.append(word.lower())
                to = behind
            content = [p for p in parts if p not in COMMON]
            if content:
                like = any(medieval_name(p, known) for p in content)
                out.append((start, to, text[start:to], "person" if like else "role", 0.55 if like else 0.25, "rule:salvage_trigger"))
        if (far := work(low)) is not None:
            works.add((start, end))
            out.append((start, end, t, "work", max(0.35, 0.65 - far), "rule:salvage_work_fuzzy"))
    for start, end, t in behind_prepositions(text, found):
        if (start, end) not in works and place_reason(t) is None:
            out.append((start, end, t, "place", 0.35, "rule:salvage_place_candidate"))
    return out


def rejected_places(text: str) -> list[tuple]:
    found = behind_prepositions(text, [(m.start(), m.end(), m.group()) for m in SALVAGE_TOKEN.finditer(text)])
    return [(start, t, reason) for start, _, t in found if (reason := place_reason(t))]


# ---- all of them --------------------------------------------------------------------------------


def without_overlaps(mentions: list[tuple]) -> list[tuple]:
    """Best confidence of each span and type; then, from the surest and longest, those that overlap no kept one of their type."""
    best: dict[tuple, tuple] = {}
    for m in mentions:
        if m[1] > m[0] and ((key := (m[3], m[0], m[1])) not in best or (m[4], m[5]) > best[key][4:]):
            best[key] = m
    kept: dict[str, list[tuple]] = {}
    for m in sorted(best.values(), key=lambda m: (-m[4], m[0] - m[1], *m[:3], m[5])):
        row = kept.setdefault(m[3], [])
        at = bisect_left(row, m[:2])
        # Kept ones are apart, so only the neighbours can overlap.
        if (at == 0 or row[at - 1][1] <= m[0]) and (at == len(row) or row[at][0] >= m[1]):
            row.insert(at, m)
    return [m for row in kept.values() for m in row]


def salvaged_mentions(docs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    return K.by_text(docs, SCHEMA, lambda text: salvaged(text, known), "text", many=True)


def deduplicated_mentions(docs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """The union of four extractors (names in a row, anchors, salvage, high recall) without overlaps."""
    return K.by_text(docs, SCHEMA, lambda text: without_overlaps(persons(text) + anchors(text) + salvaged(text, known) + high_recall(text)), "text", many=True)
