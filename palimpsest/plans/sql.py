"""Fragments of DuckDB SQL that the queries' SQL is put together from."""

from __future__ import annotations

from palimpsest.functions import constants as C

WS = r"[ \t\n\r\f\v]"


def num(x: float) -> str:
    """A DOUBLE literal (plain decimals are DECIMAL)."""
    return f"{float(x)!r}e0"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def array(values) -> str:
    return "[" + words(values)[1:-1] + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '{WS}+'), lambda w: w <> '')"


def lines(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda s: length({strip('s')}) > 0)"


def letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0e0 END)"


def kept(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]', '', 'g'))"


def vowel_share_of_length(t: str) -> str:
    return share(kept(f"lower({t})", C.VOWELS), f"length({t})")


def vowel_ratio(t: str) -> str:
    return share(kept(f"lower({t})", C.VOWELS_LATIN), letters(f"lower({t})"))


def consonant_run(t: str, vowels: str = C.VOWELS) -> str:
    return rf"coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(lower({t}), '[{vowels}]', ' ', 'g'), '\p{{L}}+'), lambda r: length(r))), 0)"


def token_quality(t: str) -> str:
    v, run, n = vowel_share_of_length(t), consonant_run(t), f"length({t})"
    return (
        f"(CASE WHEN {n} < 2 THEN 0e0 ELSE round(least(greatest(0.5e0 + (CASE WHEN {n} >= 3 AND {n} <= 20 THEN 0.15e0 WHEN {n} < 3 THEN -0.2e0 ELSE -0.1e0 END)"
        f" + (CASE WHEN {v} >= 0.25e0 AND {v} <= 0.65e0 THEN 0.2e0 WHEN {v} >= 0.15e0 AND {v} <= 0.8e0 THEN 0.05e0 ELSE -0.25e0 END)"
        f" + (CASE WHEN {run} >= 4 THEN -0.35e0 WHEN {run} = 3 THEN -0.05e0 ELSE 0e0 END)"
        f" + (CASE WHEN {letters(t)} = {n} THEN 0.1e0 ELSE -0.15e0 END), 0e0), 1e0), 3) END)"
    )


def count_of(x: str, what: str) -> str:
    return f"((length({x}) - length(replace({x}, '{what}', ''))) / {len(what)})::DOUBLE"


def runs(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def rare_bigrams(low: str) -> str:
    """Occurrences, overlapping ones of a doubled letter too."""
    parts = [count_of(low, b) for b in C.RARE_BIGRAMS if b[0] != b[1]]
    parts += [f"({count_of(low, b[0])} - {runs(low, b[0] + '+')})" for b in C.RARE_BIGRAMS if b[0] == b[1]]
    return "(" + " + ".join(parts) + ")"


def rare_bigram_ratio(x: str) -> str:
    low = f"lower({x})"
    return share(rare_bigrams(low), rf"({letters(low)} - {runs(low, chr(92) + 'p{L}+')})")


def non_wordlike(t: str) -> str:
    low, n = f"lower({t})", f"length(lower({t}))"
    alpha, v, run = letters(low), vowel_ratio(t), consonant_run(t, C.VOWELS_LATIN)
    return (
        f"(CASE WHEN {n} < 2 THEN 0.5e0 ELSE least(1e0, (CASE WHEN {alpha} > 0 THEN least(0.3e0, ({n} - {alpha})::DOUBLE / {n}) ELSE 0e0 END)"
        f" + (CASE WHEN {v} < 0.12e0 THEN 0.3e0 WHEN {v} < 0.18e0 THEN 0.15e0 WHEN {v} > 0.8e0 THEN 0.2e0 ELSE 0e0 END)"
        f" + (CASE WHEN {run} >= 5 THEN 0.35e0 WHEN {run} >= 4 THEN 0.15e0 ELSE 0e0 END)"
        f" + (CASE WHEN {alpha} >= 4 THEN {rare_bigram_ratio(t)} * 0.5e0 ELSE 0e0 END)) END)"
    )


def uncertainty(x: str) -> str:
    return share(f"({count_of(x, '?')} + {count_of(x, '…')} + {count_of(x, '[…]')} * 3)", f"length({x})")


def bigrams(x: str) -> str:
    return f"(CASE WHEN length({x}) >= 2 THEN list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))) ELSE [] END)"


def dice(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END)"


def jaccard(a: str, b: str, both_empty: float = 1.0) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN {num(both_empty)} ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END)"


def edit_distance(a: str, b: str) -> str:
    n = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {n} = 0 THEN 0e0 ELSE levenshtein({a}, {b})::DOUBLE / {n} END)"


def folded(x: str) -> str:
    return f"translate(replace(lower({x}), 'rn', 'm'), 'il1uvce', 'IIIUUCC')"


def leading_fragment(line: str) -> str:
    w = f"{tokens(line)}[1]"
    return (
        rf"(regexp_matches({w}, '^[-–—]') OR (lower({w}) NOT IN {words(C.FUNCTION_WORDS)} AND ((regexp_matches({w}, '^\p{{L}}$') AND NOT regexp_matches(lower({w}), '^[{C.VOWELS_LATIN}]$'))"
        rf" OR (regexp_matches({w}, '^\p{{L}}{{2}}$') AND NOT regexp_matches({w}, '^\p{{Lu}}')))))"
    )


def trailing_break(line: str) -> str:
    w = f"{tokens(line)}[-1]"
    return rf"(regexp_matches({w}, '-$') OR regexp_matches({w}, '^\p{{L}}$'))"


def trailing_fragment(line: str) -> str:
    w = f"{tokens(line)}[-1]"
    return rf"(regexp_matches({w}, '-$') OR (length(regexp_replace({line}, '{WS}+$', '')) >= 2 AND regexp_matches({w}, '^\p{{L}}$') AND NOT regexp_matches(lower({w}), '^[{C.VOWELS_LATIN}]$')))"


def share_of(rows: str, test: str, name: str) -> str:
    return share(f"len(list_filter({rows}, lambda {name}: {test}))", f"len({rows})")
