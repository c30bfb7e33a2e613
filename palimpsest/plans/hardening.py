"""Sanity metrics, confidence caps, language evidence, masking: further rules over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import lines as L
from palimpsest.functions import text as T
from palimpsest.operators import extraction as X
from palimpsest.operators.passes import best_of_line
from palimpsest.plans import sql as Q
from palimpsest.plans.store import C_SQL, D_SQL, M_SQL, candidates, decisions, mentions, read
from palimpsest.plans.text_quality import DOCS, REPORT_SQL, documents, gates, per_document, quality_report
from palimpsest.registry import register

# Vowels of the sanity rules, unlikely bigrams, language evidence.
VOWELS = C.VOWELS_LATIN
FRENCH_ANCHORS = "tres tresreuerend pere euesque eusque prince lausanne laufanne grace considerat desirs chapellain seruiteur approchant".split()
FRENCH_WORDS = "que et de la le des".split()
FRENCH_OLD = "pur ki mei sun uostre nostre cil cest dunc".split()
FRENCH_MIDDLE = "approchant considerat grace mille cens chapellain seruiteur desirs lausanne prince pere".split()
LATIN_ANCHORS = "domini amen quod canonici capitulum instrumentum publicum consensu confirmamus perpetuo".split()

junk = lambda w: (T.letters(w) < 3) | (T.vowel_ratio(w) < 0.20) | ((F.length(w) - T.letters(w)) / F.length(w) > 0.30)
Q_JUNK = f"({Q.letters('x')} < 3 OR {Q.vowel_ratio('x')} < 0.2e0 OR (length(x) - {Q.letters('x')})::DOUBLE / length(x) > 0.3e0)"


def junk_ratio(toks):
    long_ones = F.filter(toks, lambda w: F.length(w) >= 3)
    return T.share(F.size(F.filter(long_ones, junk)).cast("double"), F.size(long_ones))


Q_TOKS, Q_ROWS = Q.tokens("text"), Q.lines("text")
Q_RATIO = Q.share_of(f"list_filter({Q_TOKS}, lambda y: length(y) >= 3)", Q_JUNK, "x")
per_document("T48_junk_ratio", lambda text, toks, rows: {"ratio": F.round(junk_ratio(toks), 4)}, {"ratio": f"round({Q_RATIO}, 4)"})
per_document("T50_confidence_caps", lambda text, toks, rows: {"confidence": F.when((junk_ratio(toks) >= 0.35) | ((T.letters(text) < 120) & (junk_ratio(toks) >= 0.25)), F.least(F.lit(0.9), F.lit(0.75))).when(junk_ratio(toks) >= 0.20, F.least(F.lit(0.9), F.lit(0.85))).otherwise(0.9)}, {"confidence": f"CASE WHEN {Q_RATIO} >= 0.35e0 OR ({Q.letters('text')} < 120 AND {Q_RATIO} >= 0.25e0) THEN 0.75e0 WHEN {Q_RATIO} >= 0.2e0 THEN 0.85e0 ELSE 0.9e0 END"})
RUNS = r"coalesce(len(list_filter(range(1, len(c) - 3), lambda i: c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4])), 0)"


def repeat_share(text):
    runs = F.regexp_extract_all(text, F.lit(r"((.)\2{4,})"), F.lit(1))
    return T.share(F.aggregate(F.transform(runs, lambda r: F.length(r) - 4), F.lit(0), lambda a, x: a + x).cast("double"), F.length(text))


register("T54_garbage_ratio", lambda s, d: documents(s, d).select("doc_id", F.round(repeat_share(F.col("text")), 6).alias("ratio")), f"WITH {DOCS} SELECT doc_id, round(CASE WHEN length(text) > 0 THEN {RUNS}::DOUBLE / length(text) ELSE 0e0 END, 6) AS ratio FROM (SELECT doc_id, text, string_split(text, '') AS c FROM docs)")


def sanity(docs: DataFrame) -> DataFrame:
    """Shares of single characters, digits, odd tokens, junk, broken line starts and uncertainty marks."""
    toks, rows = F.col("toks"), F.col("lns")
    part = lambda test: F.round(T.share_of_lines(toks, test), 6)
    odd = lambda w: ((T.letters(w) >= 10) & (T.vowel_ratio(w) < 0.20)) | ((T.letters(w) > 0) & (F.lower(w).rlike("[bcdfghjklmnpqrstvwxyz]{5,}") | F.lower(w).rlike("|".join(C.RARE_BIGRAMS))))
    waste = lambda w: (F.length(w) >= 2) & ((F.length(w) - T.letters(w) - F.length(F.regexp_replace(w, r"[^?…\[\]'\-–—.,;:]", ""))) / F.length(w) > 0.40)
    base = docs.withColumn("toks", T.tokens("text")).withColumn("lns", T.lines("text"))
    return base.select(
        "doc_id", part(lambda w: F.length(w) == 1).alias("single"), part(lambda w: w.rlike("[0-9]")).alias("digit"), part(odd).alias("odd"), part(waste).alias("junk"),
        F.round(T.share_of_lines(rows, lambda r: F.length(F.element_at(T.tokens(r), 1)) == 1), 6).alias("starts"), part(lambda w: w.contains("?") | (w == "[…]")).alias("marks"),
    )


Q_ODD = f"(({Q.letters('x')} >= 10 AND {Q.vowel_ratio('x')} < 0.2e0) OR ({Q.letters('x')} > 0 AND (regexp_matches(lower(x), '[bcdfghjklmnpqrstvwxyz]{{5,}}') OR regexp_matches(lower(x), '{'|'.join(C.RARE_BIGRAMS)}'))))"
Q_WASTE = rf"(length(x) >= 2 AND (length(x) - {Q.letters('x')} - length(regexp_replace(x, '[^?…\[\]''\-–—.,;:]', '', 'g')))::DOUBLE / length(x) > 0.4e0)"
SANITY = (
    f"{DOCS}, sanity AS (SELECT doc_id, round({Q.share_of('toks', 'length(x) = 1', 'x')}, 6) AS single, round({Q.share_of('toks', 'regexp_matches(x, ' + chr(39) + '[0-9]' + chr(39) + ')', 'x')}, 6) AS digit, round({Q.share_of('toks', Q_ODD, 'x')}, 6) AS odd, round({Q.share_of('toks', Q_WASTE, 'x')}, 6) AS junk, "
    f"round({Q.share_of('lns', 'length(' + Q.tokens('x') + '[1]) = 1', 'x')}, 6) AS starts, round({Q.share_of('toks', '(contains(x, ' + chr(39) + '?' + chr(39) + ') OR x = ' + chr(39) + '[…]' + chr(39) + ')', 'x')}, 6) AS marks FROM (SELECT doc_id, {Q_TOKS} AS toks, {Q_ROWS} AS lns FROM docs))"
)
register("T52_sanity", lambda s, d: sanity(documents(s, d)), f"WITH {SANITY} SELECT * FROM sanity")


def sanity_confidence(raw: float):
    out = F.lit(raw) * (1 - F.col("single")) * (1 - F.col("odd")) * (1 - F.col("junk"))
    out = F.when((F.col("marks") == 0) & ((F.col("odd") > 0.05) | (F.col("junk") > 0.03)), out * 0.70).otherwise(out)
    out = F.when(F.col("single") > 0.15, out * 0.60).otherwise(out)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), out))


register("T53_sanity_confidence", lambda s, d: sanity(documents(s, d)).select("doc_id", F.round(sanity_confidence(0.9), 6).alias("confidence")), f"WITH {SANITY} SELECT doc_id, round(greatest(0.05e0, least(0.95e0, 0.9e0 * (1 - single) * (1 - odd) * (1 - junk) * (CASE WHEN marks = 0 AND (odd > 0.05e0 OR junk > 0.03e0) THEN 0.7e0 ELSE 1e0 END) * (CASE WHEN single > 0.15e0 THEN 0.6e0 ELSE 1e0 END))), 6) AS confidence FROM sanity")
label = lambda: F.when((F.col("single") < 0.05) & (F.col("digit") < 0.01) & (F.col("odd") < 0.08) & (F.col("junk") < 0.03), "HIGH").when((F.col("single") < 0.10) & (F.col("digit") < 0.01) & (F.col("odd") < 0.15) & (F.col("junk") < 0.06), "MEDIUM").otherwise("LOW")
register("P30_P31_sanity_label", lambda s, d: sanity(documents(s, d)).select("doc_id", label().alias("label"), ((F.col("single") < 0.2) & (F.col("digit") < 0.2) & (F.col("junk") < 0.2)).alias("sane")), f"WITH {SANITY} SELECT doc_id, CASE WHEN single < 0.05e0 AND digit < 0.01e0 AND odd < 0.08e0 AND junk < 0.03e0 THEN 'HIGH' WHEN single < 0.1e0 AND digit < 0.01e0 AND odd < 0.15e0 AND junk < 0.06e0 THEN 'MEDIUM' ELSE 'LOW' END AS label, single < 0.2e0 AND digit < 0.2e0 AND junk < 0.2e0 AS sane FROM sanity")
register("W20_better_result", lambda s, d: sanity(documents(s, d)).join(documents(s, d).select("doc_id", "source"), "doc_id").withColumn("penalty", F.round(2 * F.col("single") + 1.5 * F.col("digit") + F.col("junk") - 0.45, 6)).groupBy("source").agg(F.min_by("doc_id", F.struct("penalty", "doc_id")).alias("best")), f"WITH {SANITY} SELECT source, doc_id AS best FROM sanity JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(2 * single + 1.5e0 * digit + junk - 0.45e0, 6), doc_id) = 1")

DUP = f"(CASE WHEN len({Q_ROWS}) >= 2 THEN 1 - len(list_distinct(list_transform({Q_ROWS}, lambda s: lower(regexp_replace({Q.strip('s')}, '{Q.WS}+', ' ', 'g')))))::DOUBLE / len({Q_ROWS}) ELSE 0e0 END)"


def line_duplicates(rows):
    keys = F.transform(rows, lambda x: F.lower(T.collapse(x)))
    return F.when(F.size(rows) >= 2, 1 - F.size(F.array_distinct(keys)) / F.size(rows)).otherwise(0.0)


register("P32_low_text_quality", lambda s, d: documents(s, d).select("doc_id", ((F.length(T.strip("text")) == 0) | (repeat_share(F.col("text")) >= 0.22) | ((line_duplicates(T.lines("text")) >= 0.40) & (F.size(T.lines("text")) >= 8))).alias("low")), f"WITH {DOCS} SELECT doc_id, length({Q.strip('text')}) = 0 OR (CASE WHEN length(text) > 0 THEN {RUNS}::DOUBLE / length(text) ELSE 0e0 END) >= 0.22e0 OR ({DUP} >= 0.4e0 AND len({Q_ROWS}) >= 8) AS low FROM (SELECT doc_id, text, string_split(text, '') AS c FROM docs)")


def hallucinated(s, d):
    """Long, many lines, repeated lines and six-word runs, hardly any doubt: most frequent run by an explode and two counts."""
    base = documents(s, d).withColumn("rows", T.lines("text")).withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit("([A-Za-zÀ-ÿ]{3,})"), F.lit(1)))
    base = base.where((F.length("text") >= 900) & (F.size("rows") >= 12) & (F.size("w") >= 140) & (line_duplicates(F.col("rows")) >= 0.28))
    runs = base.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))).alias("g"))
    return runs.groupBy("doc_id", "g").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.max("n").alias("most")).where("most >= 4")


register("P33_hallucinated_passage", hallucinated, f"WITH {DOCS}, b AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-zÀ-ÿ]{{3,}}') AS w FROM docs WHERE length(text) >= 900 AND len({Q_ROWS}) >= 12 AND {DUP} >= 0.28e0), g AS (SELECT doc_id, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM b WHERE len(w) >= 140)) SELECT doc_id, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 4")


def text_score(text, rows):
    total, alpha = F.length(text), T.letters(text)
    printable = F.length(F.regexp_replace(text, r"[\x00-\x1f\x7f]", ""))
    short = T.share_of_lines(rows, lambda r: F.length(T.strip(r)) <= 2)
    words = F.regexp_count(text, F.lit("[A-Za-zÀ-ÿ]+"))
    score = 0.40 * F.least(F.lit(1.0), alpha / F.greatest(total * 0.6, F.lit(1.0))) + 0.30 * printable / F.greatest(total, F.lit(1)) + 0.20 * (1.0 - short) + 0.10 * F.least(F.lit(1.0), words / 20.0)
    score = score - F.least(F.lit(0.20), T.occurrences(text, "…") / F.greatest(total, F.lit(1)))
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


Q_SCORE = rf"(CASE WHEN length(t) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 0.4e0 * least(1e0, {Q.letters('t')} / greatest(length(t) * 0.6e0, 1e0)) + 0.3e0 * length(regexp_replace(t, '[\x00-\x1f\x7f]', '', 'g')) / greatest(length(t), 1) + 0.2e0 * (1 - {Q.share_of(Q.lines('t'), 'length(' + Q.strip('x') + ') <= 2', 'x')}) + 0.1e0 * least(1e0, len(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) / 20e0) - least(0.2e0, {Q.count_of('t', '…')} / greatest(length(t), 1)))) END)"
register("T56_text_quality_score", lambda s, d: documents(s, d).withColumn("t", T.strip("text")).select("doc_id", F.round(text_score(F.col("t"), T.lines("t")), 6).alias("score")), f"WITH {DOCS} SELECT doc_id, round({Q_SCORE}, 6) AS score FROM (SELECT doc_id, {Q.strip('text')} AS t FROM docs)")
per_document("T62_latin_lock", lambda text, toks, rows: {"foreign": F.regexp_count(text, F.lit(r"[\p{IsGreek}\p{IsCyrillic}\p{IsHan}]")), "sha": F.sha2(T.collapse(F.regexp_replace(F.regexp_replace(text, r"\?{6,}", "[…]"), r"[\p{IsGreek}\p{IsCyrillic}\p{IsHan}]", "?")), 256)}, {"foreign": r"len(regexp_extract_all(text, '[\p{Greek}\p{Cyrillic}\p{Han}]'))::INT", "sha": rf"sha256(regexp_replace({Q.strip('regexp_replace(regexp_replace(text, ' + chr(39) + chr(92) + '?{6,}' + chr(39) + ', ' + chr(39) + '[…]' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[' + chr(92) + 'p{Greek}' + chr(92) + 'p{Cyrillic}' + chr(92) + 'p{Han}]' + chr(39) + ', ' + chr(39) + '?' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{Q.WS}+', ' ', 'g'))"})
META = "as an ai|i cannot|i'm sorry|unable to (read|transcribe)|here is the (text|transcription)"
per_document("P39_meta_text", lambda text, toks, rows: {"meta": F.lower(text).rlike(META)}, {"meta": f"regexp_matches(lower(text), '{META.replace(chr(39), chr(39) * 2)}')"})
bad = lambda w: (w.rlike("[0-9]") & ~F.upper(w).rlike("^[IVXLCDM]+$")) | F.lower(w).rlike("|".join(C.RARE_BIGRAMS)) | F.lower(w).rlike("[bcdfghjklmnpqrstvwxyz]{5,}")
Q_BAD = f"((regexp_matches(y, '[0-9]') AND NOT regexp_matches(upper(y), '^[IVXLCDM]+$')) OR regexp_matches(lower(y), '{'|'.join(C.RARE_BIGRAMS)}') OR regexp_matches(lower(y), '[bcdfghjklmnpqrstvwxyz]{{5,}}'))"


def language_tokens(toks):
    """Letters of tokens that are at least half letters, long ones with vowels; lower case, v and j folded."""
    good = F.filter(toks, lambda w: (T.letters(w) > 0) & ((F.length(w) - T.letters(w)) / F.length(w) <= 0.5))
    bare = F.transform(good, lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    kept = F.filter(bare, lambda w: (F.length(w) < 4) | (T.vowel_ratio(w) >= 0.20))
    return F.transform(kept, lambda w: F.translate(F.lower(w), "ſvj", "sui"))


Q_LANG = rf"list_transform(list_filter(list_transform(list_filter({Q_TOKS}, lambda x: {Q.letters('x')} > 0 AND (length(x) - {Q.letters('x')})::DOUBLE / length(x) <= 0.5e0), lambda x: regexp_replace(x, '[^\p{{L}}]', '', 'g')), lambda x: length(x) < 4 OR {Q.vowel_ratio('x')} >= 0.2e0), lambda x: translate(lower(x), 'ſvj', 'sui'))"
hits = lambda toks, known: F.size(F.filter(language_tokens(toks), lambda w: w.isin(*known)))
q_hits = lambda known: f"len(list_filter({Q_LANG}, lambda y: y IN {Q.words(known)}))"
per_document("T74_latin_anchor_hits", lambda text, toks, rows: {"hits": F.size(F.array_intersect(language_tokens(toks), T.quoted(LATIN_ANCHORS)))}, {"hits": f"len(list_intersect({Q_LANG}, {Q.array(LATIN_ANCHORS)}))::INT"})


def french(toks):
    strong, function, old, middle = (hits(toks, x) for x in (FRENCH_ANCHORS, FRENCH_WORDS, FRENCH_OLD, FRENCH_MIDDLE))
    return F.when(~((strong >= 2) | ((strong >= 1) & (function >= 2))), None).when((old >= 2) & (middle == 0), "old_french").otherwise("middle_french")


Q_FRENCH = f"CASE WHEN NOT ({q_hits(FRENCH_ANCHORS)} >= 2 OR ({q_hits(FRENCH_ANCHORS)} >= 1 AND {q_hits(FRENCH_WORDS)} >= 2)) THEN NULL WHEN {q_hits(FRENCH_OLD)} >= 2 AND {q_hits(FRENCH_MIDDLE)} = 0 THEN 'old_french' ELSE 'middle_french' END"
per_document("T70_T96_french_family", lambda text, toks, rows: {"language": french(toks)}, {"language": Q_FRENCH})


def detected(text, toks):
    """Script first, then French and Latin evidence, then the trigram profile that fits best."""
    fit = {name: F.size(F.filter(T.trigrams(text), lambda g: F.array_contains(T.quoted(C.TRIGRAMS[name]), g))) for name in ("latin", "french")}  # noqa: B023
    return F.when(text.rlike("[\\x{0600}-\\x{06FF}]"), "arabic").when(text.rlike("[\\x{0590}-\\x{05FF}]"), "hebrew").when(french(toks).isNotNull(), french(toks)).when(F.size(toks) == 0, "unknown").when(fit["latin"] >= fit["french"], "latin").otherwise("french")


TRI = rf"WITH {DOCS}, lst AS (SELECT doc_id, text, {Q_TOKS} AS toks FROM docs), w AS (SELECT doc_id, regexp_replace(lower(unnest(toks)), '[^\p{{L}}]', '', 'g') AS w FROM lst), tri AS (SELECT doc_id, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS g FROM w WHERE length(w) >= 3), f AS (SELECT doc_id, count(*) FILTER (g IN {Q.words(C.TRIGRAMS['latin'])}) AS la, count(*) FILTER (g IN {Q.words(C.TRIGRAMS['french'])}) AS fr FROM tri GROUP BY 1)"
register("T71_T73_T97_detected_language", lambda s, d: documents(s, d).select("doc_id", detected(F.col("text"), T.tokens("text")).alias("language")), TRI + rf" SELECT d.doc_id, CASE WHEN regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') THEN 'arabic' WHEN regexp_matches(text, '[\x{{0590}}-\x{{05FF}}]') THEN 'hebrew' WHEN {Q_FRENCH} IS NOT NULL THEN {Q_FRENCH} WHEN len({Q_TOKS}) = 0 THEN 'unknown' WHEN coalesce(la, 0) >= coalesce(fr, 0) THEN 'latin' ELSE 'french' END AS language FROM docs d LEFT JOIN f USING (doc_id)")
CORRECTIONS = {"tho": "the", "teh": "the", "ofthe": "of", "ano": "and"}
per_document("T86_initial_letter", lambda text, toks, rows: {"letter": F.upper(F.regexp_extract(text, r"^\s*([A-Za-z])", 1))}, {"letter": r"upper(regexp_extract(text, '^\s*([A-Za-z])', 1))"})
per_document("T95_T108_plain_text", lambda text, toks, rows: {"sha": F.sha2(T.strip(F.regexp_replace(F.concat(F.lit("```text\n"), text, F.lit("\n```")), "^```[a-z]*\n|\n```$", "")), 256)}, {"sha": f"sha256({Q.strip('text')})"})
per_document("T109_T110_clean_list", lambda text, toks, rows: {"items": F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, r"[;•,|]"), lambda x: F.substring(T.strip(x), 1, 300)), lambda x: x != ""))), 1, 6), "/")}, {"items": f"coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[;•,|]'), lambda x: substr({Q.strip('x')}, 1, 300)), lambda x: x <> '')))[1:6], '/'), '')"})
per_document("T111_tokenise", lambda text, toks, rows: {"n": F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")))}, {"n": r"len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')))::INT"})
register("P6_effective_quality", lambda s, d: gates(quality_report(documents(s, d))).select("doc_id", (F.length("blocked") == 0).alias("clear"), F.when(F.col("blocked").contains("token_ner"), "vision").otherwise("tokens").alias("mode")), f"WITH {REPORT_SQL} SELECT doc_id, NOT (gibberish >= 0.4e0 OR non_wordlike >= 0.55e0 OR greatest(lead_share, seam_share) >= 0.15e0 OR label IN ('RISKY', 'UNRELIABLE')) AS clear, CASE WHEN gibberish >= 0.4e0 OR non_wordlike >= 0.55e0 OR label = 'UNRELIABLE' THEN 'vision' ELSE 'tokens' END AS mode FROM report")
register("T119_gate_report", lambda s, d: gates(quality_report(documents(s, d))).select("doc_id", F.concat_ws(" ", F.concat(F.lit("gibberish="), F.when(F.col("gibberish_gate"), "pass").otherwise("fail")), F.concat(F.lit("words="), F.when(F.col("non_wordlike_gate"), "pass").otherwise("fail"))).alias("report")), f"WITH {REPORT_SQL} SELECT doc_id, concat_ws(' ', concat('gibberish=', CASE WHEN gibberish < 0.4e0 THEN 'pass' ELSE 'fail' END), concat('words=', CASE WHEN non_wordlike < 0.55e0 THEN 'pass' ELSE 'fail' END)) AS report FROM report")

# ---- sequential rules: no SQL, literal tests --------------------------------------------------


def word_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token, single): the tokens of whole texts; ``single`` marks lone letters."""
    rows = docs.select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "token"))
    return rows.withColumn("single", F.col("token").rlike(r"^\p{L}$"))


def collapsed(rows: DataFrame) -> DataFrame:
    """Texts in which every masked stretch of (doc_id, pos, token, masked) is one gap, and how many tokens were lost."""
    before = F.lag("masked", 1, False).over(Window.partitionBy("doc_id").orderBy("pos"))
    shown = F.when(~F.col("masked"), F.col("token")).when(~before, "[…]")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("pos", "shown")))), lambda x: x["shown"]), " ")
    return rows.withColumn("shown", shown).groupBy("doc_id").agg(F.count(F.when(F.col("masked"), 1)).alias("lost"), F.sha2(text, 256).alias("sha"))


def single_runs(s, d) -> DataFrame:
    """Runs of three lone letters and more: islands by the difference of two numberings."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = word_rows(documents(s, d)).withColumn("island", F.row_number().over(by_doc) - F.row_number().over(Window.partitionBy("doc_id", "single").orderBy("pos")))
    size = F.count("*").over(Window.partitionBy("doc_id", "single", "island"))
    return collapsed(rows.withColumn("masked", F.col("single") & (size >= 3)))


def fragments(s, d) -> DataFrame:
    """Tokens in any window of five with three lone letters and more."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    ahead = by_doc.rowsBetween(0, 4)
    rows = word_rows(documents(s, d)).withColumn("bad", (F.count("*").over(ahead) == 5) & (F.sum(F.col("single").cast("int")).over(ahead) / 5 >= 0.6))
    return collapsed(rows.withColumn("masked", F.max("bad").over(by_doc.rowsBetween(-4, 0))))


WORD_ROWS = rf"{DOCS}, wr AS (SELECT doc_id, pos, token, regexp_matches(token, '^\p{{L}}$') AS single FROM (SELECT doc_id, unnest(range(len({Q_TOKS}))) AS pos, unnest({Q_TOKS}) AS token FROM docs))"
COLLAPSED = "SELECT doc_id, count(*) FILTER (masked) AS lost, sha256(string_agg(CASE WHEN masked THEN '[…]' ELSE token END, ' ' ORDER BY pos) FILTER (NOT masked OR NOT before)) AS sha FROM (SELECT *, lag(masked, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM ma) GROUP BY 1"
register("W14_single_runs", single_runs, f"WITH {WORD_ROWS}, isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, single ORDER BY pos) AS island FROM wr), ma AS (SELECT *, single AND count(*) OVER (PARTITION BY doc_id, single, island) >= 3 AS masked FROM isl) {COLLAPSED}")
register(
    "W15_T64_fragment_sequences",
    fragments,
    f"WITH {WORD_ROWS}, ba AS (SELECT *, count(*) OVER f = 5 AND sum(single::INT) OVER f >= 3 AS bad FROM wr WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), ma AS (SELECT *, max(bad) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS masked FROM ba) {COLLAPSED}",
)


def merged_lines(s, d):
    """Lines of a text that repeat each other closely, each such set by its best reading."""
    base = documents(s, d).select("doc_id", F.split("text", "\n").alias("ls"))
    rows = base.select("doc_id", F.posexplode(F.arrays_zip("ls", L.founders_udf()("ls").alias("entry"))).alias("pos", "x")).select("doc_id", "pos", F.col("x.entry").alias("entry"), T.strip("x.ls").alias("text"), F.lit(0.9).alias("confidence"))
    return best_of_line(rows.where("entry >= 0")).select("doc_id", "entry", F.sha2("text", 256).alias("sha"), "readings")


register("W6_W7_merged_lines", merged_lines)

# ---- mentions and links -------------------------------------------------------------------------
register("P21_P23_unresolved_types", lambda s, d: mentions(s, d).select("mention_id", F.when((F.col("ent_type") == "place") & (F.col("confidence") < 0.3), "possible_place_unresolved").otherwise(F.col("ent_type")).alias("shown"), F.concat_ws("; ", F.lit("deferred"), F.when((F.col("ent_type") == "place") & (F.col("confidence") < 0.3), "low_evidence_place")).alias("reason")), f"WITH {M_SQL} SELECT mention_id, CASE WHEN ent_type = 'place' AND confidence < 0.3e0 THEN 'possible_place_unresolved' ELSE ent_type END AS shown, CASE WHEN ent_type = 'place' AND confidence < 0.3e0 THEN 'deferred; low_evidence_place' ELSE 'deferred' END AS reason FROM mentions")


def name_likeness(token):
    """0.5 moved by length, vowels and consonant runs; never below 0 (a single content token)."""
    v, run, n = T.vowel_share_of_length(token), T.longest_consonant_run(token), F.length(token)
    score = 0.5 - F.when((n < 3) | (n > 20), 0.30).otherwise(0.0) + F.when((v < 0.15) | (v > 0.85), -0.30).when(v.between(0.25, 0.65), 0.15).otherwise(0.0) - F.when(run >= 4, 0.35).otherwise(0.0)
    return F.when(F.lower(token).isin(*C.COMMON_WORDS), 0.05).otherwise(F.round(F.greatest(F.lit(0.0), score), 3))


def tokens_of(s, d):
    return documents(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("token")).distinct()


LETTER_TOKENS = rf"{DOCS}, tok AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token FROM docs)"
Q_V, Q_RUN = Q.vowel_share_of_length("token"), Q.consonant_run("token")
register("T114_candidate_source", lambda s, d: candidates(s, d).select("mention_id", "cand_key", F.coalesce(F.nullif("source", F.lit("viaf")), F.when(F.col("cand_key") % 2 == 0, "viaf"), F.lit("unknown")).alias("resolved")), f"WITH {C_SQL} SELECT mention_id, cand_key, coalesce(nullif(source, 'viaf'), CASE WHEN cand_key % 2 = 0 THEN 'viaf' END, 'unknown') AS resolved FROM candidates")
register("C12_text_or_lines", lambda s, d: read(s, d, "documents").select("doc_id", F.coalesce(F.nullif("text", F.lit("")), "lang").alias("shown")), "SELECT doc_id, coalesce(nullif(text, ''), lang) AS shown FROM documents")
register("C1_sorted_files", lambda s, d: read(s, d, "pages").where(F.col("url").rlike("^https?://")).select("page_id", "url").orderBy("url", "page_id"), "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://') ORDER BY url, page_id")
