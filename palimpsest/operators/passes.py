"""Two passes over the same pages: stability, agreement, proofreading verdicts and markers for unstable tokens."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T
from palimpsest.functions import tokens as K

GAP = "[…]"
# Limits of the proofreading rules.
EDIT_LIMIT, DRIFT_LIMIT, RETENTION_LEAST, CHURN_LIMIT = 0.40, 0.30, 0.50, 0.50


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance with a column of the table in the bits of two integers: one step for each character of ``b``."""
    shared = len(os.path.commonprefix([a, b]))
    a, b = a[shared:], b[shared:]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        level = here | down
        across = ((here & up) + up) ^ up | here
        right_up, right_down = down | every & ~(across | up), up & across
        distance += (right_up >> last & 1) - (right_down >> last & 1)
        right_up, right_down = (right_up << 1 | 1) & every, right_down << 1 & every
        up, down = right_down | every & ~(level | right_up), right_up & level
    return distance


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of whole texts; the built-in one takes a step for every pair of characters, this one for every character."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)


def edit_share(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 0.0).when(F.least(F.length(a), F.length(b)) == 0, 1.0).otherwise(edit_distance(a, b) / longest)


def stability(a: Column, b: Column) -> Column:
    """Mean of edit similarity and token-set similarity of two normalised whole texts, four digits; 0 if one is empty."""
    mean = (1 - edit_share(a, b) + T.jaccard(F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b)))) / 2
    return F.when(a == b, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(F.round(mean, 4))


def agreement(passes: DataFrame) -> DataFrame:
    """(doc_id, agreement): trigram-set similarity of ``a`` and ``b``, by counts over exploded trigrams; 1 if neither has any."""
    both = None
    for side in ("a", "b"):
        grams = passes.select("doc_id", F.explode(F.array_distinct(T.trigrams(F.col(side)))).alias("g"))
        both = grams if both is None else both.unionByName(grams)
    share = both.groupBy("doc_id", "g").agg(F.count("*").alias("n")).groupBy("doc_id").agg((F.count(F.when(F.col("n") == 2, 1)) / F.count("*")).alias("share"))
    return passes.select("doc_id").join(share, "doc_id", "left").select("doc_id", F.round(F.coalesce("share", F.lit(1.0)), 6).alias("agreement"))


def uncertainty_marks(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"\?")) + F.regexp_count(x, F.lit("…")) + 2 * F.regexp_count(x, F.lit(r"\[…\]")) + 2 * F.regexp_count(x, F.lit(r"\[\?\]"))


def proofread_verdict(raw: Column, proofread: Column) -> Column:
    """accepted, or the first rule that is broken: edits, change of line count, lost marks of doubt, new tokens."""
    flat = lambda x: T.collapse(F.lower(x))
    lines = lambda x: F.size(T.lines(x))
    drift = T.share(F.abs(lines(proofread) - lines(raw)).cast("double"), lines(raw))
    marks = uncertainty_marks(raw)
    retention = F.when(marks > 0, uncertainty_marks(proofread) / marks).otherwise(1.0)
    old, new = (F.array_distinct(T.tokens(F.lower(x))) for x in (raw, proofread))
    churn = T.share(F.size(F.array_except(new, old)).cast("double"), F.size(new))
    return (
        F.when(edit_share(flat(raw), flat(proofread)) > EDIT_LIMIT, "char_edit_ratio").when(drift > DRIFT_LIMIT, "line_drift")
        .when(retention < RETENTION_LEAST, "uncertainty_stripped").when(churn > CHURN_LIMIT, "token_churn").otherwise("accepted")
    )


# ---- markers for unstable tokens -------------------------------------------------------


def unlikely(token: Column) -> Column:
    return F.lower(token).rlike("|".join(C.UNLIKELY_BIGRAMS))


def false_hyphen(token: Column, unstable: Column) -> Column:
    """A token of two parts that shows at least three of: a change of case at the hyphen, unlikely bigrams, a part of two signs at most, instability."""
    left, right = F.substring_index(token, "-", 1), F.substring_index(token, "-", -1)
    signs = [
        token.rlike(r"\p{Ll}-\p{Lu}|\p{Lu}-\p{Ll}"), unlikely(F.concat(left, right)),
        F.least(F.length(left), F.length(right)) <= 2, unstable,
    ]
    return token.rlike("^[^-]+-[^-]+$") & (sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 3)


def positioned_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, line, pos, token) of all lines, numbered from 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "l"))
    return lines.select("doc_id", "line", F.posexplode(T.tokens("l")).alias("pos", "token"))


def unstable_tokens(passes: DataFrame) -> DataFrame:
    """(doc_id, token): tokens that one pass has in a line and the other has not in the same line."""
    sides = positioned_tokens(passes, "a").select("doc_id", "line", "token", F.lit(1).alias("side")).unionByName(positioned_tokens(passes, "b").select("doc_id", "line", "token", F.lit(2).alias("side")))
    return sides.groupBy("doc_id", "line", "token").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high").select("doc_id", "token").distinct()


def marked_passes(passes: DataFrame) -> DataFrame:
    """(doc_id, text, marks): pass ``a`` with its unstable garbage masked, token by token; nothing is ever corrected."""
    return K.by_text(passes, "text string, marks long", K.marked, "a", "b")


# ---- lines of overlapping tiles -----------------------------------------------------------


def best_of_line(rows: DataFrame) -> DataFrame:
    """Of the readings of one line (doc_id, entry, text, confidence, pos) the least doubtful, then the surest, then the longest, then the first."""
    doubt = F.regexp_count("text", F.lit(r"\?")) + 3 * F.regexp_count("text", F.lit(r"\[…\]"))
    order = F.struct(doubt, -F.round("confidence", 6), -F.length("text"), F.col("pos"))
    return rows.groupBy("doc_id", "entry").agg(F.min_by("text", order).alias("text"), F.count("*").alias("readings"))
