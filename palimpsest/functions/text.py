"""Scalar text functions as Column expressions.

White space is the explicit class SPACE everywhere (Java and RE2 read ``\\s``
differently), letters are ``\\p{L}``, places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import constants as C

SPACE = r"[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0  ]"
TRIM = rf"^{SPACE}+|{SPACE}+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), TRIM, "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space, none at either end."""
    return F.regexp_replace(strip(x), f"{SPACE}+", " ")


def tokens(x: Column | str) -> Column:
    """White-space separated tokens; an empty text has none."""
    return F.filter(F.split(strip(x), f"{SPACE}+"), lambda t: t != "")


def lines(x: Column | str) -> Column:
    """Lines that hold more than white space."""
    return F.filter(F.split(col(x), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda s: F.length(strip(s)) > 0)


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]", ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def vowel_share_of_length(token: Column) -> Column:
    low = F.lower(token)
    return share(F.length(F.regexp_replace(low, f"[^{C.VOWELS}]", "")).cast("double"), F.length(token))


def vowel_ratio(token: Column) -> Column:
    """Vowels of the Latin set over letters; 0 without letters."""
    low = F.lower(token)
    return share(F.length(F.regexp_replace(low, f"[^{C.VOWELS_LATIN}]", "")).cast("double"), letters(low))


def longest_consonant_run(token: Column, vowels: str = C.VOWELS) -> Column:
    runs = F.regexp_extract_all(F.regexp_replace(F.lower(token), f"[{vowels}]", " "), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def token_quality(token: Column) -> Column:
    """0.50, moved by length, vowel share, consonant runs and letters; clamped to 0..1, three digits."""
    n, v, run = F.length(token), vowel_share_of_length(token), longest_consonant_run(token)
    score = (
        F.lit(0.50)
        + F.when((n >= 3) & (n <= 20), 0.15).when(n < 3, -0.20).otherwise(-0.10)
        + F.when((v >= 0.25) & (v <= 0.65), 0.20).when((v >= 0.15) & (v <= 0.80), 0.05).otherwise(-0.25)
        + F.when(run >= 4, -0.35).when(run == 3, -0.05).otherwise(0.0)
        + F.when(letters(token) == n, 0.10).otherwise(-0.15)
    )
    return F.when(n < 2, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3))


def text_quality_label(toks: Column) -> Column:
    """HIGH, MEDIUM or LOW by the mean token quality and the share of tokens below 0.30."""
    scores = F.transform(toks, token_quality)
    n = F.size(toks)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    low = F.size(F.filter(scores, lambda x: x < 0.30)) / n
    return F.when(n == 0, "LOW").when((mean >= 0.55) & (low < 0.15), "HIGH").when((mean >= 0.35) & (low < 0.40), "MEDIUM").otherwise("LOW")


def rare_bigrams(low: Column) -> Column:
    return F.regexp_count(low, F.lit("(?=" + "|".join(C.RARE_BIGRAMS) + ")"))


def letter_bigrams(low: Column) -> Column:
    """Neighbouring letters: letters less runs of letters."""
    return letters(low) - F.regexp_count(low, F.lit(r"\p{L}+"))


def rare_bigram_ratio(text: Column) -> Column:
    low = F.lower(text)
    return share(rare_bigrams(low).cast("double"), letter_bigrams(low))


def non_wordlike(token: Column) -> Column:
    """0 for a word, 1 for gibberish (Latin script)."""
    low = F.lower(token)
    n, alpha = F.length(low), letters(low)
    v, run = vowel_ratio(token), longest_consonant_run(token, C.VOWELS_LATIN)
    score = (
        F.when(alpha > 0, F.least(F.lit(0.3), (n - alpha) / n)).otherwise(0.0)
        + F.when(v < 0.12, 0.30).when(v < 0.18, 0.15).when(v > 0.80, 0.20).otherwise(0.0)
        + F.when(run >= 5, 0.35).when(run >= 4, 0.15).otherwise(0.0)
        + F.when(alpha >= 4, rare_bigram_ratio(token) * 0.5).otherwise(0.0)
    )
    return F.when(n < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), score))


def occurrences(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def uncertainty_density(text: Column) -> Column:
    marks = occurrences(text, "?") + occurrences(text, "…") + occurrences(text, "[…]") * 3
    return share(marks, F.length(text))


def gibberish_score(bad: Column, entropy: Column, rare: Column, uncertain: Column) -> Column:
    """0 for words, 1 for gibberish: unlike words, odd entropy, rare bigrams and doubt."""
    penalty = F.when(entropy < 2.0, 0.3).when(entropy > 5.5, 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), 0.40 * bad + 0.20 * penalty + 0.20 * F.least(F.lit(1.0), rare * 5) + 0.20 * F.least(F.lit(1.0), uncertain * 5))


def _first(line: Column) -> Column:
    return F.element_at(tokens(line), 1)


def _last(line: Column) -> Column:
    return F.element_at(tokens(line), -1)


def leading_fragment(line: Column) -> Column:
    """The line starts with a dash, a single consonant, or two lower-case letters that are no function word."""
    w = _first(line)
    low = F.lower(w)
    one = (F.length(w) == 1) & w.rlike(r"^\p{L}$") & ~low.rlike(f"^[{C.VOWELS_LATIN}]$")
    two = (F.length(w) == 2) & w.rlike(r"^\p{L}{2}$") & ~w.rlike(r"^\p{Lu}")
    return w.rlike("^[-–—]") | (~low.isin(*C.FUNCTION_WORDS) & (one | two))


def trailing_break(line: Column) -> Column:
    w = _last(line)
    return w.rlike("-$") | w.rlike(r"^\p{L}$")


def trailing_fragment(line: Column) -> Column:
    w = _last(line)
    right = F.regexp_replace(line, f"{SPACE}+$", "")
    return w.rlike("-$") | ((F.length(right) >= 2) & w.rlike(r"^\p{L}$") & ~F.lower(w).rlike(f"^[{C.VOWELS_LATIN}]$"))


def share_of_lines(rows: Column, test) -> Column:
    return share(F.size(F.filter(rows, test)).cast("double"), F.size(rows))


def leading_fragment_ratio(rows: Column) -> Column:
    return share_of_lines(rows, leading_fragment)


def seam_fragment_ratio(rows: Column, seams: Column | None = None) -> Column:
    """Lines broken at either end; with ``seams`` (line numbers from 0) only lines next to one count."""
    if seams is not None:
        near = F.transform(seams, lambda s: F.sequence(s - 1, s + 1))
        places = F.flatten(near)
        kept = F.filter(rows, lambda x, i: F.array_contains(places, i))
        rows = F.when(F.size(seams) > 0, kept).otherwise(rows)
    return share_of_lines(rows, lambda s: leading_fragment(s) | trailing_break(s))


def trailing_fragment_ratio(rows: Column) -> Column:
    return share_of_lines(rows, trailing_fragment)


def quality_label(gibberish: Column, uncertainty: Column, stability: Column, bad: Column, entropy: Column, seam: Column, leading: Column) -> Column:
    """First match of UNRELIABLE, RISKY, HIGH, OK; a null stability was not computed."""
    return (
        F.when((gibberish >= C.GIBBERISH_HARD_LIMIT) | (uncertainty >= C.UNCERTAINTY_HARD_LIMIT) | F.coalesce(stability < C.STABILITY_MINIMUM, F.lit(False)) | (bad >= C.NON_WORDLIKE_HARD_LIMIT) | (entropy < 1.5), "UNRELIABLE")
        .when((gibberish >= C.GIBBERISH_SOFT_LIMIT) | (bad >= C.NON_WORDLIKE_SOFT_LIMIT) | (seam >= C.SEAM_FRAGMENT_LIMIT) | (leading >= C.LEADING_FRAGMENT_LIMIT) | (entropy < C.ENTROPY_LOW) | (entropy > C.ENTROPY_HIGH) | (uncertainty >= C.UNCERTAINTY_SOFT_LIMIT), "RISKY")
        .when((gibberish < 0.10) & (bad < 0.15) & (leading < 0.06) & (seam < 0.05) & (uncertainty < 0.03) & entropy.between(2.5, 5.0), "HIGH")
        .otherwise("OK")
    )


def character_bigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, 2)))).otherwise(F.array().cast("array<string>"))


def set_dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def bigram_overlap(a: Column, b: Column) -> Column:
    return set_dice(character_bigrams(F.lower(a)), character_bigrams(F.lower(b)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalized_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def confusion_folded(x: Column) -> Column:
    return F.translate(F.replace(F.lower(x), F.lit("rn"), F.lit("m")), "il1uvce", "IIIUUCC")


def confusion_fixes(x: Column) -> Column:
    for old, new in C.CONFUSION_REPLACEMENTS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.regexp_replace(x, r"(?<=[\p{L}\p{N}_])[|¦](?=[\p{L}\p{N}_])", "")


def trigrams(text: Column) -> Column:
    """Letter trigrams of each token, lower case."""
    words = F.filter(F.transform(tokens(text), lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}]", "")), lambda w: F.length(w) >= 3)
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3))))


def profile(language: Column) -> Column:
    """The trigrams of a language, aliases included; null if it has no profile."""
    out = None
    for name, known in C.TRIGRAMS.items():
        test = language.isin(name, *[a for a, to in C.TRIGRAM_ALIASES.items() if to == name])
        out = F.when(test, quoted(known)) if out is None else out.when(test, quoted(known))
    return out


def lexical_plausibility(text: Column, language: Column) -> Column:
    found, known = trigrams(text), profile(language)
    hits = F.size(F.filter(found, lambda t: F.array_contains(known, t)))
    return F.when(known.isNull() | (F.size(found) == 0), 0.50).otherwise(F.least(F.lit(1.0), hits / F.size(found) / 0.55))


def script_family(text: Column) -> Column:
    """The script of at least 80 % of the letters, else mixed; unknown without letters."""
    ranges: dict[str, str] = {}
    for name, low, high in C.SCRIPT_RANGES:
        ranges[name] = ranges.get(name, "") + f"\\x{{{low:X}}}-\\x{{{high:X}}}"

    def verdict(kept: Column) -> Column:
        # Scripts share no letter, so at most one holds 80 %; counts behind the first such are not made.
        out = F.when(F.length(kept) == 0, "unknown")
        for name, r in ranges.items():
            out = out.when(F.length(F.regexp_replace(kept, f"[^{r}]+", "")) / F.length(kept) >= 0.80, name)
        return out.otherwise("mixed")

    # An array of one: its letters are kept once and not anew for every count.
    return F.transform(F.array(F.regexp_replace(text, r"[^\p{L}]+", "")), verdict)[0]
