"""Text and token quality over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T
from palimpsest.functions import tokens as K
from palimpsest.plans import sql as Q
from palimpsest.registry import register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.explode(T.tokens("text")).alias("token")).distinct()


DOCS = "docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)"
TOKENS = f"{DOCS}, tok AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS token FROM docs)"
ENTROPY = (
    "ent AS (SELECT d.doc_id, coalesce(e.entropy, 0e0) AS entropy FROM docs d LEFT JOIN (SELECT doc_id, -sum(p * log2(p)) AS entropy FROM "
    "(SELECT doc_id, n::DOUBLE / size AS p FROM (SELECT doc_id, c, count(*) AS n, any_value(size) AS size FROM "
    "(SELECT doc_id, length(text) AS size, unnest(string_split(lower(text), '')) AS c FROM docs) WHERE c <> '' GROUP BY doc_id, c)) GROUP BY doc_id) e USING (doc_id))"
)


def per_token(name: str, column: Callable[[Column], Column], expression: str, out: str) -> None:
    register(name, lambda spark, d: distinct_tokens(spark, d).select("token", column(F.col("token")).alias(out)), f"WITH {TOKENS} SELECT token, {expression} AS {out} FROM tok")


def per_document(name: str, columns: Callable[[Column, Column, Column], dict[str, Column]], expressions: dict[str, str], wide: bool = False) -> None:
    """``columns`` gets the text, its tokens and its lines; ``wide``: a table of few files is dealt over all cores first."""
    register(
        name,
        lambda spark, d: (spread if wide else lambda df: df)(documents(spark, d)).select("doc_id", *[c.alias(k) for k, c in columns(F.col("text"), T.tokens("text"), T.lines("text")).items()]),
        f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in expressions.items()) + " FROM docs",
    )


q_toks, q_rows = Q.tokens("text"), Q.lines("text")

per_token("T5_vowel_share", lambda token: F.round(T.vowel_share_of_length(token), 6), f"round({Q.vowel_share_of_length('token')}, 6)", "vowel_share")
per_token("T6_vowel_ratio", lambda token: F.round(T.vowel_ratio(token), 6), f"round({Q.vowel_ratio('token')}, 6)", "vowel_ratio")
per_token("T7_vowel_anomaly", lambda token: (T.vowel_ratio(token) < 0.15) | (T.vowel_ratio(token) > 0.75), f"({Q.vowel_ratio('token')} < 0.15e0 OR {Q.vowel_ratio('token')} > 0.75e0)", "anomaly")
per_token("T8_consonant_run", lambda token: T.longest_consonant_run(token), Q.consonant_run("token"), "longest_run")
per_token("T9_token_quality", lambda token: T.token_quality(token), Q.token_quality("token"), "quality")
per_token("T12_confusion_folding", lambda token: T.confusion_folded(token), Q.folded("token"), "folded")
per_token("T13_character_bigrams", lambda token: F.array_join(F.array_sort(T.character_bigrams(token)), "|"), f"array_to_string(list_sort({Q.bigrams('token')}), '|')", "bigrams")
per_token("T39_non_wordlike", lambda token: F.round(T.non_wordlike(token), 6), f"round({Q.non_wordlike('token')}, 6)", "score")
per_token("P10_common_word", lambda token: F.lower(token).isin(*C.COMMON_WORDS), f"lower(token) IN {Q.words(C.COMMON_WORDS)}", "common")
per_token("P13_roman_numeral", lambda token: F.upper(token).rlike("^[IVXLCDM]+$"), "regexp_matches(upper(token), '^[IVXLCDM]+$')", "roman")
per_token("P47_name_like", lambda token: (F.length(token) >= 18) | token.rlike(r"^.+\p{Lu}"), r"(length(token) >= 18 OR regexp_matches(token, '^.+\p{Lu}'))", "name_like")
per_token("P48_line_like", lambda token: F.lower(token).rlike("line|numbering|row"), "regexp_matches(lower(token), 'line|numbering|row')", "line_like")
per_token("T102_language_token", lambda token: F.translate(F.lower(token), "ſvj", "sui"), "translate(lower(token), 'ſvj', 'sui')", "folded")
per_token("T103_token_vowel_ratio", lambda token: F.round(T.vowel_share_of_length(token), 4), f"round({Q.vowel_share_of_length('token')}, 4)", "vowel_ratio")
per_token("T46_unlikely_bigrams", lambda token: F.lower(token).rlike("|".join(C.RARE_BIGRAMS)), f"regexp_matches(lower(token), '{'|'.join(C.RARE_BIGRAMS)}')", "unlikely")
per_token(
    "P34_suspicious_token",
    lambda token: (token.rlike("[0-9]") & ~F.upper(token).rlike("^[IVXLCDM]+$")) | ((F.length(token) >= 6) & (T.vowel_ratio(token) < 0.15)) | F.lower(token).rlike("|".join(C.RARE_BIGRAMS)) | F.lower(token).rlike(r"(.)\1\1") | (T.longest_consonant_run(token, C.VOWELS_LATIN) >= 5),
    f"((regexp_matches(token, '[0-9]') AND NOT regexp_matches(upper(token), '^[IVXLCDM]+$')) OR (length(token) >= 6 AND {Q.vowel_ratio('token')} < 0.15e0) OR regexp_matches(lower(token), '{'|'.join(C.RARE_BIGRAMS)}')"
    f" OR len(list_filter(range(1, length(token) - 1), lambda i: substr(lower(token), i, 1) = substr(lower(token), i + 1, 1) AND substr(lower(token), i, 1) = substr(lower(token), i + 2, 1))) > 0 OR {Q.consonant_run('token', C.VOWELS_LATIN)} >= 5)",
    "suspicious",
)
per_token(
    "P36_pattern_junk",
    lambda token: token.rlike(r"\?{6}") | token.rlike(r"(.)\1{6}") | ((T.letters(token) >= 10) & (F.size(F.array_distinct(F.split(F.regexp_replace(F.lower(token), r"[^\p{L}]", ""), ""))) <= 2)),
    f"(contains(token, '??????') OR len(list_filter(range(1, length(token) - 5), lambda i: substr(token, i, 7) = repeat(substr(token, i, 1), 7))) > 0 OR ({Q.letters('token')} >= 10 AND len(list_distinct(string_split(regexp_replace(lower(token), '[^\\p{{L}}]', '', 'g'), ''))) <= 2))",
    "junk",
)
per_token("T91_span_key", lambda token: F.concat_ws(":", F.lit(0), F.length(token), token), "concat_ws(':', 0, length(token), token)", "span_key")
per_token("T90_sha256", lambda token: F.sha2(token, 256), "sha256(token)", "sha256")
per_token("T112_cache_key", lambda token: F.sha2(F.concat_ws(":", F.lit("wikidata"), F.lower(token), F.lit("fr"), F.lit("")), 256), "sha256(concat_ws(':', 'wikidata', lower(token), 'fr', ''))", "cache_key")

per_document("T2_confusion_fixes", lambda text, toks, rows: {"fixed": F.sha2(T.confusion_fixes(text), 256)}, {"fixed": "sha256(regexp_replace(" + "".join("replace(" for _ in C.CONFUSION_REPLACEMENTS) + "text" + "".join(f", '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in C.CONFUSION_REPLACEMENTS) + r", '([\p{L}\p{N}_])[|¦]([\p{L}\p{N}_])', '\1\2', 'g'))"})
per_document("T10_text_quality_label", lambda text, toks, rows: {"label": T.text_quality_label(toks)}, {"label": f"(SELECT CASE WHEN count(*) = 0 THEN 'LOW' WHEN avg(s) >= 0.55e0 AND count(*) FILTER (s < 0.3e0)::DOUBLE / count(*) < 0.15e0 THEN 'HIGH' WHEN avg(s) >= 0.35e0 AND count(*) FILTER (s < 0.3e0)::DOUBLE / count(*) < 0.4e0 THEN 'MEDIUM' ELSE 'LOW' END FROM (SELECT {Q.token_quality('w')} AS s FROM (SELECT unnest({q_toks}) AS w)))"})
per_document("T38_rare_bigram_ratio", lambda text, toks, rows: {"ratio": F.round(T.rare_bigram_ratio(text), 6)}, {"ratio": f"round({Q.rare_bigram_ratio('text')}, 6)"})
per_document("T40_uncertainty_density", lambda text, toks, rows: {"density": F.round(T.uncertainty_density(text), 6)}, {"density": f"round({Q.uncertainty('text')}, 6)"})
per_document("T42_leading_fragment_ratio", lambda text, toks, rows: {"ratio": F.round(T.leading_fragment_ratio(rows), 4)}, {"ratio": f"round({Q.share_of(q_rows, Q.leading_fragment('x'), 'x')}, 4)"})
per_document("T43_trailing_fragment_ratio", lambda text, toks, rows: {"ratio": F.round(T.trailing_fragment_ratio(rows), 4)}, {"ratio": f"round({Q.share_of(q_rows, Q.trailing_fragment('x'), 'x')}, 4)"})
per_document(
    "T44_seam_fragment_ratio",
    lambda text, toks, rows: {"everywhere": F.round(T.seam_fragment_ratio(rows), 4), "at_seams": F.round(T.seam_fragment_ratio(rows, F.array(F.lit(2), F.lit(5))), 4)},
    {
        "everywhere": f"round({Q.share_of(q_rows, '(' + Q.leading_fragment('x') + ' OR ' + Q.trailing_break('x') + ')', 'x')}, 4)",
        "at_seams": f"round({Q.share_of(f'list_concat({q_rows}[2:4], {q_rows}[5:7])', '(' + Q.leading_fragment('x') + ' OR ' + Q.trailing_break('x') + ')', 'x')}, 4)",
    },
)
per_document("A18_line_duplicate_ratio", lambda text, toks, rows: {"ratio": F.round(F.when(F.size(rows) > 0, 1 - F.size(F.array_distinct(F.transform(rows, lambda s: F.lower(T.collapse(s))))) / F.size(rows)).otherwise(0.0), 6)}, {"ratio": f"round(CASE WHEN len({q_rows}) > 0 THEN 1 - len(list_distinct(list_transform({q_rows}, lambda s: lower(regexp_replace({Q.strip('s')}, '{Q.WS}+', ' ', 'g')))))::DOUBLE / len({q_rows}) ELSE 0e0 END, 6)"})
per_document("T49_letter_count", lambda text, toks, rows: {"letters": F.regexp_count(text, F.lit(r"\p{L}"))}, {"letters": Q.letters("text")})
per_document("T60_uncertainty_score", lambda text, toks, rows: {"score": T.occurrences(text, "?") + 3 * T.occurrences(text, "[…]")}, {"score": f"{Q.count_of('text', '?')} + 3 * {Q.count_of('text', '[…]')}"})
per_document("T79_uncertainty_markers", lambda text, toks, rows: {"markers": T.occurrences(text, "?") + T.occurrences(text, "…")}, {"markers": f"{Q.count_of('text', '?')} + {Q.count_of('text', '…')}"})
per_document("T61_uncertainty_tokens", lambda text, toks, rows: {"sha": F.sha2(F.regexp_replace(text, r"\[\.\.\.\]|\.\.\.|…", "[…]"), 256)}, {"sha": r"sha256(regexp_replace(text, '\[\.\.\.\]|\.\.\.|…', '[…]', 'g'))"})
per_document("T68_surface_norm", lambda text, toks, rows: {"sha": F.sha2(F.lower(T.collapse(text)), 256)}, {"sha": f"sha256(lower(regexp_replace({Q.strip('text')}, '{Q.WS}+', ' ', 'g')))"})
per_document("T59_line_key", lambda text, toks, rows: {"sha": F.sha2(T.collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")), 256)}, {"sha": rf"sha256(regexp_replace({Q.strip(chr(114) + 'egexp_replace(lower(text), ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{Q.WS}+', ' ', 'g'))"})
per_document("T75_strip_uncertainty", lambda text, toks, rows: {"sha": F.sha2(F.regexp_replace(text, r"\[…\]|\[\.\.\.\]|\[\?\]|…|\?", ""), 256)}, {"sha": r"sha256(regexp_replace(text, '\[…\]|\[\.\.\.\]|\[\?\]|…|\?', '', 'g'))"})
per_document("T81_short_text", lambda text, toks, rows: {"short": F.when(F.length(T.collapse(text)) > 180, F.concat(F.regexp_replace(F.substring(T.collapse(text), 1, 179), f"{T.SPACE}+$", ""), F.lit("…"))).otherwise(T.collapse(text))}, {"short": f"(SELECT CASE WHEN length(s) > 180 THEN concat(rtrim(substr(s, 1, 179)), '…') ELSE s END FROM (SELECT regexp_replace({Q.strip('text')}, '{Q.WS}+', ' ', 'g') AS s))"})
per_document("T99_clean_lines", lambda text, toks, rows: {"n": F.size(rows), "sha": F.sha2(F.array_join(F.transform(rows, T.strip), "\n"), 256)}, {"n": f"len({q_rows})", "sha": f"sha256(coalesce(array_to_string(list_transform({q_rows}, lambda s: {Q.strip('s')}), chr(10)), ''))"})
per_document("T76_strip_uncertainty_lines", lambda text, toks, rows: {"n": F.size(F.filter(F.transform(rows, lambda s: T.strip(F.regexp_replace(s, r"\[…\]|…|\?", ""))), lambda s: s != ""))}, {"n": rf"len(list_filter({q_rows}, lambda x: regexp_replace(regexp_replace(x, '\[…\]|…|\?', '', 'g'), '{Q.WS}', '', 'g') <> ''))"})
per_document("X7_token_set", lambda text, toks, rows: {"tokens": F.size(F.array_distinct(T.tokens(F.lower(text))))}, {"tokens": f"len(list_distinct({Q.tokens('lower(text)')}))"})
per_document("T80_query_terms", lambda text, toks, rows: {"terms": F.array_join(F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= 2))), " ")}, {"terms": r"coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 2))), ' '), '')"})
per_document("P12_date_anchor", lambda text, toks, rows: {"dated": text.rlike(r"(?i)(^|[^\p{L}\p{N}])(l['’]an|lan|an +de +grace) +(mil|mille)([^\p{L}\p{N}]|$)") | text.rlike(r"(^|[^\p{L}\p{N}_])[0-9]{3,4}([^\p{L}\p{N}_]|$)") | F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("([A-Za-zÀ-ÿ'’]+)"), F.lit(1)), T.quoted(C.DATE_ANCHORS + C.MONTHS)) | text.rlike(r"(^|[^\p{L}\p{N}_])M{1,4}[CDLXVI]{2,}([^\p{L}\p{N}_]|$)")}, {"dated": rf"(regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}])(l[''’]an|lan|an +de +grace) +(mil|mille)([^\p{{L}}\p{{N}}]|$)') OR regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])[0-9]{{3,4}}([^\p{{L}}\p{{N}}_]|$)') OR list_has_any(regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ''’]+'), {Q.array(C.DATE_ANCHORS + C.MONTHS)}) OR regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_])M{{1,4}}[CDLXVI]{{2,}}([^\p{{L}}\p{{N}}_]|$)'))"})
per_document("P14_entity_cues", lambda text, toks, rows: {"cues": F.arrays_overlap(F.filter(T.tokens(F.lower(text)), lambda w: w.isNotNull()), T.quoted(C.PLACE_ANCHORS + C.TITLE_ANCHORS + ["roi", "saint", "dame", "the"]))}, {"cues": f"coalesce(list_has_any({Q.tokens('lower(text)')}, {Q.array(C.PLACE_ANCHORS + C.TITLE_ANCHORS + ['roi', 'saint', 'dame', 'the'])}), false)"})
per_document("T35_script_family", lambda text, toks, rows: {"script": T.script_family(text)}, {"script": rf"CASE WHEN {Q.letters('text')} = 0 THEN 'unknown' WHEN length(regexp_replace(text, '[^\p{{Latin}}ªº]', '', 'g'))::DOUBLE / {Q.letters('text')} >= 0.8e0 THEN 'latin' ELSE 'mixed' END"}, wide=True)
per_document("T36_script_hint", lambda text, toks, rows: {"hint": F.when(text.rlike(r"[\p{IsGreek}]") & text.rlike("[A-Za-z]"), "mixed").when(text.rlike(r"[\p{IsGreek}]"), "greek").when(text.rlike(r"[\p{IsCyrillic}]"), "cyrillic").when(text.rlike("[A-Za-zÀ-ɏ]"), "latin").otherwise("unknown")}, {"hint": r"CASE WHEN regexp_matches(text, '\p{Greek}') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '\p{Greek}') THEN 'greek' WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'cyrillic' WHEN regexp_matches(text, '[A-Za-zÀ-ɏ]') THEN 'latin' ELSE 'unknown' END"})
per_document("T37_insular_hint", lambda text, toks, rows: {"hint": F.when(text.rlike("[ꝺꝼꞃꞅꞇᵹ]"), "insular").when(text.rlike("[A-Za-z]"), "latin").otherwise("unknown")}, {"hint": "CASE WHEN regexp_matches(text, '[ꝺꝼꞃꞅꞇᵹ]') THEN 'insular' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'unknown' END"})
per_document("P40_script_drift", lambda text, toks, rows: {"drift": text.rlike(r"[\p{IsGreek}\p{IsCyrillic}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")}, {"drift": r"regexp_matches(text, '[\p{Greek}\p{Cyrillic}\p{Han}\p{Hiragana}\p{Katakana}]')"})
per_document("T55_script_drift_ratio", lambda text, toks, rows: {"ratio": F.round(T.share((T.letters(text) - F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", ""))).cast("double"), T.letters(text)), 6)}, {"ratio": rf"round({Q.share('(' + Q.letters('text') + chr(32) + '- length(regexp_replace(text, ' + chr(39) + '[^' + chr(92) + 'p{Latin}]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')))', Q.letters('text'))}, 6)"})
single = lambda w: F.length(w) == 1
per_document(
    "T51_sanity_metrics",
    lambda text, toks, rows: {"single": F.round(T.share(F.size(F.filter(toks, single)).cast("double"), F.size(toks)), 4), "digit": F.round(T.share(F.size(F.filter(toks, lambda w: w.rlike("[0-9]"))).cast("double"), F.size(toks)), 4), "no_letter": F.round(T.share(F.size(F.filter(toks, lambda w: ~w.rlike(r"\p{L}"))).cast("double"), F.size(toks)), 4)},
    {"single": f"round({Q.share_of(q_toks, 'length(x) = 1', 'x')}, 4)", "digit": f"round({Q.share_of(q_toks, 'regexp_matches(x, ' + chr(39) + '[0-9]' + chr(39) + ')', 'x')}, 4)", "no_letter": rf"round({Q.share_of(q_toks, 'NOT regexp_matches(x, ' + chr(39) + chr(92) + 'p{L}' + chr(39) + ')', 'x')}, 4)"},
)
per_document("T31_trigrams", lambda text, toks, rows: {"n": F.size(T.trigrams(text)), "first": F.array_min(T.trigrams(text))}, {"n": rf"coalesce(list_sum(list_transform({q_toks}, lambda x: greatest(0, {Q.letters('lower(x)')} - 2))), 0)::INT", "first": rf"list_min(flatten(list_transform(list_transform({q_toks}, lambda x: regexp_replace(lower(x), '[^\p{{L}}]', '', 'g')), lambda x: list_transform(range(1, greatest(1, length(x) - 1)), lambda i: substr(x, i, 3)))))"})
Q_LANGUAGE = "CASE lang WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE 'unknown' END"


def lexical(spark: SparkSession, d: str) -> DataFrame:
    language = F.when(F.col("lang") == "fr", "french").when(F.col("lang") == "es", "spanish").otherwise("unknown")
    p = T.lexical_plausibility(F.col("text"), language)
    confidence = F.lit(0.8)
    adjusted = F.least(F.greatest(F.when(p < 0.35, confidence * 0.55).when(p < 0.60, confidence * 0.75).otherwise(confidence * 1.05), F.lit(0.05)), F.lit(0.95))
    return documents(spark, d).select("doc_id", F.round(p, 4).alias("plausibility"), F.round(adjusted, 4).alias("confidence"), F.when(p < 0.35, "LEXICAL_IMPLAUSIBLE").when(p < 0.60, "LEXICAL_UNCERTAIN").alias("warning"))


register(
    "T32_T33_lexical_trust",
    lexical,
    rf"WITH {DOCS}, w AS (SELECT doc_id, lang, regexp_replace(lower(unnest({q_toks})), '[^\p{{L}}]', '', 'g') AS w FROM docs), tri AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS t FROM w WHERE length(w) >= 3), "
    f"h AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((lang = 'fr' AND t IN {Q.words(C.TRIGRAMS['french'])}) OR (lang = 'es' AND t IN {Q.words(C.TRIGRAMS['latin'])})) AS hits FROM tri GROUP BY doc_id), "
    "p AS (SELECT d.doc_id, CASE WHEN d.lang NOT IN ('fr', 'es') OR h.n IS NULL THEN 0.5e0 ELSE least(1e0, h.hits::DOUBLE / h.n / 0.55e0) END AS p FROM docs d LEFT JOIN h USING (doc_id)) "
    "SELECT doc_id, round(p, 4) AS plausibility, round(least(greatest(CASE WHEN p < 0.35e0 THEN 0.8e0 * 0.55e0 WHEN p < 0.6e0 THEN 0.8e0 * 0.75e0 ELSE 0.8e0 * 1.05e0 END, 0.05e0), 0.95e0), 4) AS confidence, CASE WHEN p < 0.35e0 THEN 'LEXICAL_IMPLAUSIBLE' WHEN p < 0.6e0 THEN 'LEXICAL_UNCERTAIN' END AS warning FROM p",
)
register("A13_char_entropy", lambda spark, d: documents(spark, d).select("doc_id").join(entropies(spread(documents(spark, d).select("doc_id", "text"))), "doc_id", "left").select("doc_id", F.round(F.coalesce("entropy", F.lit(0.0)), 4).alias("entropy")), f"WITH {DOCS}, {ENTROPY} SELECT doc_id, round(entropy, 4) AS entropy FROM ent")


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("token")
    return documents(spark, d).select("doc_id", F.explode(T.tokens("text")).alias("token")).groupBy("doc_id").agg(F.round(F.avg(n), 5).alias("mean"), F.round(F.stddev_pop(n), 5).alias("deviation"), F.round(F.avg((n < 3).cast("double")), 5).alias("very_short"), F.round(F.avg((n > 15).cast("double")), 5).alias("very_long"))


register("A12_token_length_stats", length_stats, f"WITH {DOCS}, t AS (SELECT doc_id, length(unnest({q_toks})) AS n FROM docs) SELECT doc_id, round(avg(n), 5) AS mean, round(stddev_pop(n), 5) AS deviation, round(avg((n < 3)::INT), 5) AS very_short, round(avg((n > 15)::INT), 5) AS very_long FROM t GROUP BY doc_id")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table is fewer files than that; otherwise as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def entropies(docs: DataFrame) -> DataFrame:
    """Bits of the distribution of lower-cased characters, from the count of each."""
    chars = docs.select("doc_id", F.length("text").alias("size"), F.explode(F.split(F.lower("text"), "")).alias("c")).where("c <> ''")
    p = F.col("n") / F.col("size")
    return chars.groupBy("doc_id", "size", "c").agg(F.count("*").alias("n")).groupBy("doc_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def quality_report(docs: DataFrame) -> DataFrame:
    """The quality record of each text: signals, label and gates (empty texts are UNRELIABLE)."""
    return graded(K.by_text(spread(docs.select("doc_id", "text")), K.SIGNALS, K.signals, "text"))


def graded(base: DataFrame, *kept: str) -> DataFrame:
    """The quality records of the signals of texts, with the columns that are to be kept."""
    bad = T.share(F.col("bad").cast("double"), F.col("long"))
    of_lines = lambda c: F.round(T.share(F.col(c).cast("double"), F.col("line_count")), 4)
    signals = base.select(
        "doc_id", *kept, "line_count", "token_count",
        F.round("entropy", 4).alias("char_entropy"),
        F.round(bad, 4).alias("non_wordlike"),
        F.round("rare", 4).alias("rare_bigrams"),
        F.when(F.col("token_count") == 0, F.lit(0.0)).otherwise(F.round(T.gibberish_score(bad, F.col("entropy"), F.col("rare"), F.col("unc")), 4)).alias("gibberish"),
        F.round("unc", 4).alias("uncertainty"),
        of_lines("lead").alias("lead_share"), of_lines("seam").alias("seam_share"), of_lines("trail").alias("trail_share"),
        F.col("odd").alias("sanitized"),
    )
    label = T.quality_label(F.col("gibberish"), F.col("uncertainty"), F.lit(None).cast("double"), F.col("non_wordlike"), F.col("char_entropy"), F.col("seam_share"), F.col("lead_share"))
    out = signals.withColumn("label", F.when(F.col("token_count") == 0, "UNRELIABLE").otherwise(label))
    return out.withColumn("allowed", F.col("label").isin("HIGH", "OK")).withColumn("seam_retry", (F.col("seam_share") >= C.SEAM_FRAGMENT_LIMIT) | (F.col("lead_share") >= C.LEADING_FRAGMENT_LIMIT))


LABEL_SQL = (
    "CASE WHEN token_count = 0 THEN 'UNRELIABLE' WHEN gibberish >= 0.4e0 OR uncertainty >= 0.15e0 OR non_wordlike >= 0.55e0 OR char_entropy < 1.5e0 THEN 'UNRELIABLE' "
    "WHEN gibberish >= 0.25e0 OR non_wordlike >= 0.35e0 OR seam_share >= 0.1e0 OR lead_share >= 0.15e0 OR char_entropy < 2e0 OR char_entropy > 5.5e0 OR uncertainty >= 0.08e0 THEN 'RISKY' "
    "WHEN gibberish < 0.1e0 AND non_wordlike < 0.15e0 AND lead_share < 0.06e0 AND seam_share < 0.05e0 AND uncertainty < 0.03e0 AND char_entropy BETWEEN 2.5e0 AND 5e0 THEN 'HIGH' ELSE 'OK' END"
)
REPORT_SQL = (
    f"{DOCS}, {ENTROPY}, lists AS (SELECT doc_id, text, {q_toks} AS toks, {q_rows} AS lns FROM docs), "
    f"nw AS (SELECT doc_id, avg(({Q.non_wordlike('w')} > 0.45e0)::INT) AS bad FROM (SELECT doc_id, unnest(toks) AS w FROM lists) WHERE length(w) >= 3 GROUP BY doc_id), "
    f"sig AS (SELECT l.doc_id, len(lns)::INT AS line_count, len(toks)::INT AS token_count, e.entropy, coalesce(nw.bad, 0e0) AS bad, {Q.rare_bigram_ratio('text')} AS rare, {Q.uncertainty('text')} AS unc, "
    f"round({Q.share_of('lns', Q.leading_fragment('x'), 'x')}, 4) AS lead_share, round({Q.share_of('lns', '(' + Q.leading_fragment('x') + ' OR ' + Q.trailing_break('x') + ')', 'x')}, 4) AS seam_share, round({Q.share_of('lns', Q.trailing_fragment('x'), 'x')}, 4) AS trail_share, "
    "len(list_filter(toks, lambda t: contains(t, '?') OR contains(t, '…') OR contains(t, '[')))::INT AS sanitized FROM lists l JOIN ent e USING (doc_id) LEFT JOIN nw USING (doc_id)), "
    "rep AS (SELECT doc_id, line_count, token_count, round(entropy, 4) AS char_entropy, round(bad, 4) AS non_wordlike, round(rare, 4) AS rare_bigrams, "
    "CASE WHEN token_count = 0 THEN 0e0 ELSE round(least(1e0, 0.4e0 * bad + 0.2e0 * (CASE WHEN entropy < 2e0 THEN 0.3e0 WHEN entropy > 5.5e0 THEN 0.2e0 ELSE 0e0 END) + 0.2e0 * least(1e0, rare * 5) + 0.2e0 * least(1e0, unc * 5)), 4) END AS gibberish, "
    "round(unc, 4) AS uncertainty, lead_share, seam_share, trail_share, sanitized FROM sig), "
    f"report AS (SELECT *, label IN ('HIGH', 'OK') AS allowed, seam_share >= 0.1e0 OR lead_share >= 0.15e0 AS seam_retry FROM (SELECT *, {LABEL_SQL} AS label FROM rep))"
)
register("T45_quality_report", lambda spark, d: quality_report(documents(spark, d)), f"WITH {REPORT_SQL} SELECT * FROM report")
register("T41_gibberish", lambda spark, d: quality_report(documents(spark, d)).select("doc_id", "gibberish"), f"WITH {REPORT_SQL} SELECT doc_id, gibberish FROM report")
register("P5_quality_label", lambda spark, d: quality_report(documents(spark, d)).groupBy("label").agg(F.count("*").alias("n")), f"WITH {REPORT_SQL} SELECT label, count(*) AS n FROM report GROUP BY label")
register("W3_quality_rank", lambda spark, d: quality_report(documents(spark, d)).select("doc_id", F.when(F.col("label") == "HIGH", 0).when(F.col("label") == "OK", 1).when(F.col("label") == "RISKY", 2).otherwise(3).alias("rank")), f"WITH {REPORT_SQL} SELECT doc_id, CASE label WHEN 'HIGH' THEN 0 WHEN 'OK' THEN 1 WHEN 'RISKY' THEN 2 ELSE 3 END AS rank FROM report")
register("P1_P2_downstream_mode", lambda spark, d: quality_report(documents(spark, d)).select("doc_id", F.when(F.col("allowed"), "token_based").otherwise("vision_fallback").alias("mode"), F.col("label").isin("RISKY", "UNRELIABLE").alias("shape_search")), f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN allowed THEN 'token_based' ELSE 'vision_fallback' END AS mode, label IN ('RISKY', 'UNRELIABLE') AS shape_search FROM report")


def gates(report: DataFrame) -> DataFrame:
    """Six named gates and the stages that they block, in the order of the gates."""
    g = lambda c, limit: F.col(c) < limit
    fragment = F.greatest("lead_share", "seam_share")
    hard = ~(g("gibberish", 0.40) & g("non_wordlike", 0.55))
    soft = F.col("label").isin("RISKY", "UNRELIABLE")
    blocked = F.array_distinct(F.flatten(F.array(
        F.when(hard | (F.col("label") == "UNRELIABLE"), T.quoted(["token_search", "token_ner"])).otherwise(F.array().cast("array<string>")),
        F.when(fragment >= 0.15, T.quoted(["seam_not_resolved"])).otherwise(F.array().cast("array<string>")),
        F.when(soft, T.quoted(["translation", "paraphrase", "entity_claims", "no_entity_claims"])).otherwise(F.array().cast("array<string>")),
    )))
    return report.select("doc_id", g("gibberish", 0.40).alias("gibberish_gate"), g("non_wordlike", 0.55).alias("non_wordlike_gate"), (fragment < 0.15).alias("fragment_gate"), g("uncertainty", 0.15).alias("uncertainty_gate"), F.round(fragment, 4).alias("fragment_value"), F.array_join(F.array_sort(blocked), ",").alias("blocked"))


register(
    "P3_P4_quality_gates",
    lambda spark, d: gates(quality_report(documents(spark, d))),
    f"WITH {REPORT_SQL} SELECT doc_id, gibberish < 0.4e0 AS gibberish_gate, non_wordlike < 0.55e0 AS non_wordlike_gate, greatest(lead_share, seam_share) < 0.15e0 AS fragment_gate, uncertainty < 0.15e0 AS uncertainty_gate, round(greatest(lead_share, seam_share), 4) AS fragment_value, "
    "array_to_string(list_sort(list_distinct(list_concat(list_concat(CASE WHEN gibberish >= 0.4e0 OR non_wordlike >= 0.55e0 OR label = 'UNRELIABLE' THEN ['token_search', 'token_ner'] ELSE [] END, CASE WHEN greatest(lead_share, seam_share) >= 0.15e0 THEN ['seam_not_resolved'] ELSE [] END), CASE WHEN label IN ('RISKY', 'UNRELIABLE') THEN ['translation', 'paraphrase', 'entity_claims', 'no_entity_claims'] ELSE [] END))), ',') AS blocked FROM report",
)
register(
    "P7_mention_recall",
    lambda spark, d: quality_report(documents(spark, d)).select("doc_id", "label", "token_count").join(documents(spark, d).select("doc_id", F.length(T.strip("text")).alias("size")), "doc_id").select("doc_id", F.when(F.col("label").isin("HIGH", "OK") & (F.col("size") >= 200), F.greatest(F.lit(1), F.floor(F.col("size") / 1000 * 2).cast("int"))).alias("expected"), (~F.col("label").isin("HIGH", "OK") | (F.col("size") < 200) | (F.col("token_count") / 50 >= F.greatest(F.lit(1), F.floor(F.col("size") / 1000 * 2)))).alias("recall_ok")),
    f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN label IN ('HIGH', 'OK') AND size >= 200 THEN greatest(1, floor(size::DOUBLE / 1000 * 2)::INT) END AS expected, NOT label IN ('HIGH', 'OK') OR size < 200 OR token_count::DOUBLE / 50 >= greatest(1, floor(size::DOUBLE / 1000 * 2)) AS recall_ok FROM (SELECT r.doc_id, label, token_count, length({Q.strip('text')}) AS size FROM report r JOIN docs USING (doc_id))",
)
register(
    "T118_report_summary",
    lambda spark, d: quality_report(documents(spark, d)).select("doc_id", F.concat(F.lit("label="), "label", F.lit(" tokens="), F.col("token_count").cast("string"), F.lit(" lines="), F.col("line_count").cast("string"), F.lit(" allowed="), F.when(F.col("allowed"), "yes").otherwise("no")).alias("summary")),
    f"WITH {REPORT_SQL} SELECT doc_id, concat('label=', label, ' tokens=', token_count, ' lines=', line_count, ' allowed=', CASE WHEN allowed THEN 'yes' ELSE 'no' END) AS summary FROM report",
)
