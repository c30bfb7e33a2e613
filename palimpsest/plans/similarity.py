"""Similarity of neighbouring tokens, dictionary matching, linking scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import similarity
from palimpsest.functions import text as T
from palimpsest.functions import tokens as K
from palimpsest.operators import passes as P
from palimpsest.plans import sql as Q
from palimpsest.plans.store import C_SQL, candidates
from palimpsest.plans.text_quality import DOCS, REPORT_SQL, TOKENS, distinct_tokens, documents, graded, spread
from palimpsest.registry import register


ACCENTED, PLAIN = "àáâãäåæçèéêëìíîïñòóôõöœùúûüýÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖŒÙÚÛÜÝ", "aaaaaaaceeeeiiiinooooooouuuuyysAAAAAAACEEEEIIIINOOOOOOOUUUUY"


def plain(x: Column) -> Column:
    """Accents off, any other sign beyond ASCII a tilde: similarities compare plain letters."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"[^\x00-\x7F]", "~")


def q_plain(x: str) -> str:
    return rf"regexp_replace(translate({x}, '{ACCENTED}', '{PLAIN}'), '[^\x00-\x7F]', '~', 'g')"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct neighbours in a text."""
    rows = spread(documents(spark, d).select("text")).select(T.tokens(plain(F.col("text"))).alias("w")).where(F.size("w") >= 2)
    both = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    return rows.select(F.explode(both).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b")).distinct()


PAIRS = f"{DOCS}, l AS (SELECT {Q.tokens(q_plain('text'))} AS w FROM docs), pairs AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM l))"


def per_pair(name: str, column: Callable[[Column, Column], Column], expression: str, out: str = "similarity") -> None:
    register(name, lambda spark, d: pairs(spark, d).select("a", "b", column(F.col("a"), F.col("b")).alias(out)), f"WITH {PAIRS} SELECT a, b, {expression} AS {out} FROM pairs")


per_pair("T14_bigram_overlap", lambda a, b: F.round(T.bigram_overlap(a, b), 6), f"round({Q.dice(Q.bigrams('lower(a)'), Q.bigrams('lower(b)'))}, 6)")
per_pair("T11_ocr_aware_similarity", lambda a, b: F.round(similarity.udfs()["ocr_aware"](a, b), 6), f"round(CASE WHEN {Q.folded('a')} = {Q.folded('b')} THEN 1e0 ELSE {Q.dice(Q.bigrams(Q.folded('a')), Q.bigrams(Q.folded('b')))} END, 6)")
per_pair("T15_T18_normalized_edit_distance", lambda a, b: F.round(T.normalized_edit_distance(a, b), 6), f"round({Q.edit_distance('a', 'b')}, 6)", "distance")
per_pair("T16_levenshtein_similarity", lambda a, b: F.round(1 - T.normalized_edit_distance(a, b), 6), f"round(1 - {Q.edit_distance('a', 'b')}, 6)")
per_pair("T19_T20_levenshtein", lambda a, b: F.levenshtein(a, b), "levenshtein(a, b)::INT", "distance")
per_pair("T24_jaro_whole_transpositions", lambda a, b: F.round(similarity.udfs()["jaro_whole"](a, b), 6), "round(jaro_similarity(a, b), 6)")
register("T21_T22_jaro_winkler", lambda s, d: pairs(s, d).select("a", "b", F.round(similarity.udfs()["jaro"]("a", "b"), 6).alias("jaro"), F.round(similarity.udfs()["jaro_winkler"]("a", "b"), 6).alias("winkler")))
register("T23_T24_string_similarity", lambda s, d: pairs(s, d).select("a", "b", F.round(similarity.udfs()["string_similarity"]("a", "b"), 6).alias("similarity")))
register("T1_normalize_unicode", lambda s, d: documents(s, d).select("doc_id", F.sha2(similarity.udfs()["normalize_unicode"]("text"), 256).alias("sha")), f"WITH {DOCS} SELECT doc_id, sha256(regexp_replace({Q.strip('nfc_normalize(text)')}, '{Q.WS}+', ' ', 'g')) AS sha FROM docs")
register("T3_T4_normalise_surface", lambda s, d: distinct_tokens(s, d).select("token", similarity.udfs()["normalise_surface"]("token").alias("bare")), rf"WITH {TOKENS} SELECT token, {Q.strip('regexp_replace(regexp_replace(strip_accents(lower(token)), ' + chr(39) + '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_ ]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + ' +' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS bare FROM tok")


def halves(s, d):
    """Two passes of a text: its first and second half of tokens."""
    toks = T.tokens(F.lower("text"))
    n = F.floor(F.size(toks) / 2).cast("int")
    return documents(s, d).where(F.size(toks) >= 2).select("doc_id", F.slice(toks, F.lit(1), n).alias("a"), F.slice(toks, n + 1, n).alias("b"))


HALVES = f"{DOCS}, l AS (SELECT doc_id, {Q.tokens('lower(text)')} AS w FROM docs), halves AS (SELECT doc_id, w[1:len(w) // 2] AS a, w[len(w) // 2 + 1:len(w) // 2 * 2] AS b FROM l WHERE len(w) >= 2)"
register("X1_token_stability", lambda s, d: halves(s, d).select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("stability")), f"WITH {HALVES} SELECT doc_id, round({Q.jaccard('a', 'b')}, 6) AS stability FROM halves")
register("T25_context_similarity", lambda s, d: halves(s, d).select("doc_id", F.round(F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(T.jaccard(F.col("a"), F.col("b"))), 6).alias("similarity")), f"WITH {HALVES} SELECT doc_id, round({Q.jaccard('a', 'b')}, 6) AS similarity FROM halves")


def second_pass(x: Column) -> Column:
    """What another pass over a page might read: noise signs gone, r and n run together."""
    return F.replace(F.regexp_replace(x, "[#*$%&|]+", ""), F.lit("rn"), F.lit("m"))


def passes(s: SparkSession, d: str) -> DataFrame:
    """Two readings ``a`` and ``b`` of every whole text."""
    return spread(documents(s, d).select("doc_id", "text")).select("doc_id", F.col("text").alias("a"), second_pass(F.col("text")).alias("b"))


PASSES = f"{DOCS}, passes AS (SELECT doc_id, text AS a, replace(regexp_replace(text, '[#*$%&|]+', '', 'g'), 'rn', 'm') AS b FROM docs)"
q_flat = lambda x: f"regexp_replace({Q.strip(x)}, '{Q.WS}+', ' ', 'g')"
folded = lambda c: plain(F.lower(T.strip(c)))
q_folded = lambda c: q_plain(f"lower({Q.strip(c)})")
register(
    "T17_cross_pass_stability",
    lambda s, d: spread(documents(s, d)).select("doc_id", F.col("text").alias("a"), second_pass(F.col("text")).alias("b")).select("doc_id", folded("a").alias("a"), folded("b").alias("b")).select("doc_id", P.stability(F.col("a"), F.col("b")).alias("stability")),
    f"WITH {PASSES}, f AS (SELECT doc_id, {q_folded('a')} AS a, {q_folded('b')} AS b FROM passes) SELECT doc_id, CASE WHEN a = b THEN 1e0 WHEN least(length(a), length(b)) = 0 THEN 0e0 ELSE round((1 - {Q.edit_distance('a', 'b')} + {Q.jaccard('list_distinct(' + Q.tokens('a') + ')', 'list_distinct(' + Q.tokens('b') + ')')}) / 2, 4) END AS stability FROM f",
)
q_marks = lambda x: rf"(len(regexp_extract_all({x}, '\?')) + len(regexp_extract_all({x}, '…')) + 2 * len(regexp_extract_all({x}, '\[…\]')) + 2 * len(regexp_extract_all({x}, '\[\?\]')))"
q_set = lambda x: f"list_distinct({Q.tokens('lower(' + x + ')')})"
register(
    "P9_proofread_delta",
    lambda s, d: spread(documents(s, d)).select("doc_id", plain(F.col("text")).alias("a"), plain(second_pass(F.col("text"))).alias("b")).select("doc_id", P.proofread_verdict(F.col("a"), F.col("b")).alias("verdict")),
    f"WITH {PASSES}, f AS (SELECT doc_id, {q_plain('a')} AS a, {q_plain('b')} AS b FROM passes), g AS (SELECT *, {q_flat('lower(a)')} AS fa, {q_flat('lower(b)')} AS fb, {q_set('a')} AS sa, {q_set('b')} AS sb FROM f), m AS (SELECT doc_id, {Q.edit_distance('fa', 'fb')} AS edit, {Q.share('abs(len(' + Q.lines('b') + ') - len(' + Q.lines('a') + '))', 'len(' + Q.lines('a') + ')')} AS drift, "
    f"CASE WHEN {q_marks('a')} > 0 THEN {q_marks('b')}::DOUBLE / {q_marks('a')} ELSE 1e0 END AS kept, {Q.share('len(sb) - len(list_intersect(sb, sa))', 'len(sb)')} AS churn FROM g) "
    "SELECT doc_id, CASE WHEN edit > 0.4e0 THEN 'char_edit_ratio' WHEN drift > 0.3e0 THEN 'line_drift' WHEN kept < 0.5e0 THEN 'uncertainty_stripped' WHEN churn > 0.5e0 THEN 'token_churn' ELSE 'accepted' END AS verdict FROM m",
)
register(
    "A17_agreement",
    lambda s, d: P.agreement(passes(s, d)),
    rf"WITH {PASSES}, tok AS (SELECT doc_id, 1 AS side, unnest({Q.tokens('a')}) AS w FROM passes UNION ALL SELECT doc_id, 2, unnest({Q.tokens('b')}) FROM passes), w AS (SELECT doc_id, side, regexp_replace(lower(w), '[^\p{{L}}]', '', 'g') AS w FROM tok), g AS (SELECT DISTINCT doc_id, side, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS g FROM w WHERE length(w) >= 3), "
    "n AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), v AS (SELECT doc_id, count(*) FILTER (n = 2)::DOUBLE / count(*) AS v FROM n GROUP BY 1) SELECT doc_id, round(coalesce(v, 1e0), 6) AS agreement FROM passes LEFT JOIN v USING (doc_id)",
)
q_positioned = lambda side: f"SELECT doc_id, line, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, line, {Q.tokens('l')} AS t FROM (SELECT doc_id, unnest(range(len(string_split({side}, chr(10))))) AS line, unnest(string_split({side}, chr(10))) AS l FROM passes))"
q_unlikely = lambda x: f"regexp_matches(lower({x}), '{'|'.join(C.UNLIKELY_BIGRAMS)}')"
PARTS_OF = ("string_split(token, '-')[1]", "string_split(token, '-')[2]")
Q_HYPHEN = rf"(regexp_matches(token, '^[^-]+-[^-]+$') AND regexp_matches(token, '\p{{Ll}}-\p{{Lu}}|\p{{Lu}}-\p{{Ll}}')::INT + {q_unlikely('replace(token, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) * 2 + ')')}::INT + (least(length({PARTS_OF[0]}), length({PARTS_OF[1]})) <= 2)::INT + unstable::INT >= 3)"
UNSTABLE = f"ta AS ({q_positioned('a')}), tb AS ({q_positioned('b')}), one AS (SELECT doc_id, line, token, 1 AS side FROM ta UNION ALL SELECT doc_id, line, token, 2 FROM tb), unst AS (SELECT DISTINCT doc_id, token, true AS unstable FROM (SELECT doc_id, line, token FROM one GROUP BY 1, 2, 3 HAVING min(side) = max(side)))"
register(
    "T47_false_hyphens",
    lambda s, d: P.positioned_tokens(passes(s, d), "a").select("doc_id", "token").distinct().join(P.unstable_tokens(passes(s, d)).withColumn("unstable", F.lit(True)), ["doc_id", "token"], "left").where(F.col("token").contains("-")).select("doc_id", "token", P.false_hyphen(F.col("token"), F.coalesce("unstable", F.lit(False))).alias("false_hyphen")),
    f"WITH {PASSES}, {UNSTABLE}, t AS (SELECT DISTINCT doc_id, token FROM ta WHERE contains(token, '-')), u AS (SELECT t.doc_id, t.token, coalesce(unstable, false) AS unstable FROM t LEFT JOIN unst USING (doc_id, token)) SELECT doc_id, token, {Q_HYPHEN} AS false_hyphen FROM u",
)
register(
    "X2_uncertainty_markers",
    lambda s, d: P.marked_passes(passes(s, d)).select("doc_id", F.sha2("text", 256).alias("sha"), "marks"),
    f"WITH {PASSES}, {UNSTABLE}, k AS (SELECT ta.*, coalesce(unstable, false) AS unstable FROM ta LEFT JOIN unst USING (doc_id, token)), m AS (SELECT doc_id, line, pos, token, CASE WHEN NOT unstable THEN token WHEN {Q_HYPHEN} THEN '[…]' WHEN {q_unlikely('token')} AND {Q.non_wordlike('token')} > 0.45e0 THEN regexp_replace(token, '\\p{{L}}', '?', 'g') WHEN {Q.non_wordlike('token')} > 0.55e0 THEN '[…]' ELSE token END AS new FROM k), "
    "l AS (SELECT doc_id, line, string_agg(new, ' ' ORDER BY pos) AS text, count(*) FILTER (new <> token) AS marks FROM m GROUP BY 1, 2), n AS (SELECT doc_id, unnest(range(len(string_split(a, chr(10))))) AS line FROM passes) "
    "SELECT doc_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY line)) AS sha, sum(coalesce(marks, 0))::BIGINT AS marks FROM n LEFT JOIN l USING (doc_id, line) GROUP BY 1",
)


def guarded(s: SparkSession, d: str) -> DataFrame:
    """Whether a proofread pass is kept: no label two ranks worse, no more gibberish, no doubt taken off worse words."""
    names = [x.split()[0] for x in K.SIGNALS.split(", ")]
    of_side = lambda x: K.SIGNALS.replace(" ", f"_{x} ").replace(f",_{x} ", ", ")
    doubt = lambda x: x.count("?") + x.count("[…]")
    rows = K.by_text(passes(s, d), f"{of_side('a')}, {of_side('b')}, empty boolean, doubt_a int, doubt_b int", lambda a, b: (*K.signals(a), *K.signals(b), not K.strip(b), doubt(a), doubt(b)), "a", "b")
    kept = ["empty", "doubt_a", "doubt_b", *[f"{c}_b" for c in names]]
    for side in "ab":
        graded_side = graded(rows.withColumns({c: F.col(f"{c}_{side}") for c in names}), *kept)
        rows = graded_side.select("doc_id", *kept, *[F.col(c).alias(f"{c}_{side}_") for c in ("label", "gibberish", "non_wordlike")])
        kept = [*kept[:3], *[f"{c}_a_" for c in ("label", "gibberish", "non_wordlike")]]
    rank = lambda c: F.when(F.col(c) == "HIGH", 0).when(F.col(c) == "OK", 1).when(F.col(c) == "RISKY", 2).otherwise(3)
    reason = (
        F.when(F.col("empty"), "empty").when(rank("label_b_") > rank("label_a_") + 1, "degraded")
        .when(F.col("gibberish_b_") > F.col("gibberish_a_") + 0.10, "gibberish")
        .when((F.col("doubt_a") > 0) & (F.col("doubt_b") == 0) & (F.col("non_wordlike_b_") > F.col("non_wordlike_a_")), "doubt_removed").otherwise("accepted")
    )
    return rows.select("doc_id", reason.alias("reason"))


REPORT_B = REPORT_SQL.replace(DOCS, "docs AS (SELECT doc_id, lang, source, replace(regexp_replace(coalesce(text, ''), '[#*$%&|]+', '', 'g'), 'rn', 'm') AS text FROM documents)")
Q_RANK = lambda c: f"CASE {c} WHEN 'HIGH' THEN 0 WHEN 'OK' THEN 1 WHEN 'RISKY' THEN 2 ELSE 3 END"
Q_DOUBT = lambda c: rf"len(regexp_extract_all({c}, '\?|\[…\]'))"
register(
    "P8_proofread_guard",
    guarded,
    f"WITH {PASSES}, ra AS (WITH {REPORT_SQL} SELECT doc_id, label, gibberish, non_wordlike FROM report), rb AS (WITH {REPORT_B} SELECT doc_id, label, gibberish, non_wordlike FROM report) "
    f"SELECT p.doc_id, CASE WHEN length({Q.strip('p.b')}) = 0 THEN 'empty' WHEN {Q_RANK('rb.label')} > {Q_RANK('ra.label')} + 1 THEN 'degraded' WHEN rb.gibberish > ra.gibberish + 0.1e0 THEN 'gibberish' WHEN {Q_DOUBT('p.a')} > 0 AND {Q_DOUBT('p.b')} = 0 AND rb.non_wordlike > ra.non_wordlike THEN 'doubt_removed' ELSE 'accepted' END AS reason FROM passes p JOIN ra ON ra.doc_id = p.doc_id JOIN rb ON rb.doc_id = p.doc_id",
)
register("T34_line_mismatch", lambda s, d: documents(s, d).select("doc_id", F.round(F.abs(F.size(T.lines("text")) - 20) / F.greatest(F.size(T.lines("text")), F.lit(20)), 6).alias("mismatch")), f"WITH {DOCS} SELECT doc_id, round(abs(len({Q.lines('text')}) - 20)::DOUBLE / greatest(len({Q.lines('text')}), 20), 6) AS mismatch FROM docs")

# ---- fuzzy dictionary -------------------------------------------------------------------
CANONICAL = ["thing", "tion", "ander", "heaven", "enter", "einung", "verlich", "ciones", "eaux", "menton", "oning", "ation"]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(CANONICAL)], "pos int, entry string")


def fuzzy(s, d, best: bool):
    """Tokens of a constant dictionary's entries: equal below five letters, else edit distance and bigrams."""
    low = plain(F.lower("token"))
    toks = distinct_tokens(s, d).select(low.alias("word")).distinct().where((F.length("word") >= 4) & ~F.col("word").isin(*C.COMMON_WORDS))
    both = toks.join(F.broadcast(dictionary(s)))  # a dozen entries, fixed
    near = T.normalized_edit_distance(F.col("word"), F.col("entry"))
    hit = both.where(F.when(F.length("word") < 5, F.col("word") == F.col("entry")).otherwise((near <= 0.25) & (T.bigram_overlap(F.col("word"), F.col("entry")) >= 0.40)))
    key = F.struct(F.round(near, 6), F.col("pos")) if best else F.struct(F.col("pos"))
    return hit.groupBy("word").agg(F.min_by("entry", key).alias("entry"))


FUZZY = f"{TOKENS}, words AS (SELECT DISTINCT {q_plain('lower(token)')} AS word FROM tok), dict AS (SELECT unnest({Q.array(CANONICAL)}) AS entry, unnest(range(0, {len(CANONICAL)})) AS pos), hit AS (SELECT word, entry, pos, round({Q.edit_distance('word', 'entry')}, 6) AS nd FROM words, dict WHERE length(word) >= 4 AND word NOT IN {Q.words(C.COMMON_WORDS)} AND CASE WHEN length(word) < 5 THEN word = entry ELSE {Q.edit_distance('word', 'entry')} <= 0.25e0 AND {Q.dice(Q.bigrams('lower(word)'), Q.bigrams('lower(entry)'))} >= 0.4e0 END)"
register("J6_best_dictionary_match", lambda s, d: fuzzy(s, d, True), f"WITH {FUZZY} SELECT word, entry FROM hit QUALIFY row_number() OVER (PARTITION BY word ORDER BY nd, pos) = 1")
register("J7_first_dictionary_match", lambda s, d: fuzzy(s, d, False), f"WITH {FUZZY} SELECT word, entry FROM hit QUALIFY row_number() OVER (PARTITION BY word ORDER BY pos) = 1")

# ---- linking scores -----------------------------------------------------------------------


def composite_score(label: Column, context: Column, compatible: Column, domain: Column) -> Column:
    raw = 0.55 * label + 0.25 * context + 0.15 * F.when(compatible, 1.0).otherwise(0.0) + 0.05 * F.when(domain > 0, F.least(F.lit(1.0), domain / 0.20)).otherwise(0.0)
    return F.least(F.greatest(raw - F.when(compatible, 0.0).otherwise(0.30), F.lit(0.0)), F.lit(1.0))


def rescored(score: Column, label: Column, name_entity: Column, compatible: Column, domain_hit: Column) -> Column:
    boost = F.when((label >= 0.95) & compatible, F.when(domain_hit, 0.92).otherwise(0.90)).when((label >= 0.85) & compatible & domain_hit, 0.88)
    return F.when(name_entity, F.least(score, F.lit(0.10))).otherwise(F.greatest(score, F.coalesce(boost, F.lit(0.0))))


SCORED = f"{C_SQL}, scored AS (SELECT mention_id, cand_key, least(greatest(0.55e0 * score + 0.25e0 * (1 - score) + 0.15e0 * (CASE WHEN compatible THEN 1e0 ELSE 0e0 END) + 0.05e0 * (CASE WHEN cand_key % 4 > 0 THEN least(1e0, (cand_key % 4) * 0.1e0 / 0.2e0) ELSE 0e0 END) - (CASE WHEN compatible THEN 0e0 ELSE 0.3e0 END), 0e0), 1e0) AS total, score, compatible FROM candidates)"


def scored(s, d):
    domain = (F.col("cand_key") % 4) * 0.1
    return candidates(s, d).select("mention_id", "cand_key", composite_score(F.col("score"), 1 - F.col("score"), F.col("compatible"), domain).alias("total"), "score", "compatible")


register("T26_composite_score", lambda s, d: scored(s, d).select("mention_id", "cand_key", F.round("total", 6).alias("total")), f"WITH {SCORED} SELECT mention_id, cand_key, round(total, 6) AS total FROM scored")
register("T28_canonical_rescore", lambda s, d: scored(s, d).select("mention_id", "cand_key", F.round(rescored(F.col("total"), F.col("score"), F.col("cand_key") % 17 == 0, F.col("compatible"), F.col("cand_key") % 2 == 0), 6).alias("total")), f"WITH {SCORED} SELECT mention_id, cand_key, round(CASE WHEN cand_key % 17 = 0 THEN least(total, 0.1e0) ELSE greatest(total, CASE WHEN score >= 0.95e0 AND compatible THEN CASE WHEN cand_key % 2 = 0 THEN 0.92e0 ELSE 0.9e0 END WHEN score >= 0.85e0 AND compatible AND cand_key % 2 = 0 THEN 0.88e0 ELSE 0e0 END) END, 6) AS total FROM scored")


def authority_score(s, d):
    """Weighted parts plus priors by source, and the bonus for a surface that an earlier mention of the run shares."""
    from pyspark.sql import Window

    earlier = F.count("*").over(Window.partitionBy("run_id", "surface").orderBy("mention_id").rangeBetween(Window.unboundedPreceding, -1))
    prior = F.when(F.col("source") == "wikidata", 0.04).when(F.col("source") == "viaf", 0.03).otherwise(0.02)
    total = 0.68 * F.col("score") + 0.12 * (1 - F.col("score")) + prior + F.when(earlier > 0, 0.05).otherwise(0.0)
    return candidates(s, d).select("mention_id", "cand_key", F.round(F.least(total, F.lit(1.0)), 4).alias("total"))


register("T27_authority_score", authority_score, f"WITH {C_SQL} SELECT mention_id, cand_key, round(least(0.68e0 * score + 0.12e0 * (1 - score) + (CASE source WHEN 'wikidata' THEN 0.04e0 WHEN 'viaf' THEN 0.03e0 ELSE 0.02e0 END) + (CASE WHEN count(*) OVER (PARTITION BY run_id, surface ORDER BY mention_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 0.05e0 ELSE 0e0 END), 1e0), 4) AS total FROM candidates")
register("T29_thresholds", lambda s, d: s.createDataFrame([(k, v["threshold"], v["margin"], v["similarity"]) for k, v in C.LINK_TIERS.items()], "tier string, threshold double, margin double, similarity double"), "SELECT * FROM (VALUES ('HIGH', 0.8e0, 0.15e0, 0.6e0), ('MEDIUM', 0.85e0, 0.15e0, 0.65e0), ('LOW', 0.9e0, 0.2e0, 0.7e0)) t(tier, threshold, margin, similarity)")


def type_compatible(kind: Column, qids: Column, description: Column) -> Column:
    known = None
    for name, allowed in C.TYPE_QIDS.items():
        test = F.arrays_overlap(qids, T.quoted(allowed))
        known = F.when(kind == name, test) if known is None else known.when(kind == name, test)
    names = F.arrays_overlap(qids, T.quoted(C.NAME_QIDS))
    told = description.rlike("(?i)king|knight|character|writer|saint") & ~description.rlike("(?i)given name|family name|surname")
    return F.when(~kind.isin(*C.TYPE_QIDS), True).when((kind == "person") & names, False).otherwise(known | ((kind == "person") & told))


def compat(s, d):
    qid = F.when(F.col("cand_key") % 7 == 0, F.array(F.lit("Q5"))).when(F.col("cand_key") % 7 == 1, F.array(F.lit("Q515"), F.lit("Q101352"))).otherwise(F.array(F.lit("Q571")))
    return candidates(s, d).select("mention_id", "cand_key", type_compatible(F.col("ent_type"), qid, F.col("description")).alias("ok"))


register("P17_type_compatible", compat, f"WITH {C_SQL} SELECT mention_id, cand_key, CASE WHEN ent_type = 'date' THEN true WHEN ent_type = 'person' AND cand_key % 7 = 1 THEN false WHEN ent_type = 'person' THEN cand_key % 7 = 0 OR (regexp_matches(description, '(?i)king|knight|character|writer|saint') AND NOT regexp_matches(description, '(?i)given name|family name|surname')) ELSE cand_key % 7 = 1 END AS ok FROM candidates")
register("P19_P20_P22_reasons", lambda s, d: candidates(s, d).select("mention_id", "cand_key", F.when(F.col("score") < 0.3, "unresolved_low_quality").when(F.col("compatible"), "linked").otherwise("unresolved").alias("status")).withColumn("open", F.col("status").startswith("unresolved")).withColumn("text", F.when(F.col("status") == "linked", "Linked to an authority.").when(F.col("status").contains("low_quality"), "Too little evidence.").otherwise("No candidate fits.")), f"WITH {C_SQL} SELECT *, starts_with(status, 'unresolved') AS open, CASE WHEN status = 'linked' THEN 'Linked to an authority.' WHEN contains(status, 'low_quality') THEN 'Too little evidence.' ELSE 'No candidate fits.' END AS text FROM (SELECT mention_id, cand_key, CASE WHEN score < 0.3e0 THEN 'unresolved_low_quality' WHEN compatible THEN 'linked' ELSE 'unresolved' END AS status FROM candidates)")
register("P24_prefilter_candidates", lambda s, d: candidates(s, d).where(~F.col("description").rlike("(?i)brushed|plated")).select("mention_id", "cand_key", F.round(F.col("score") + F.when(F.lower("label") == F.lower("surface"), 0.30).when(F.lower("label").contains(F.lower("surface")), 0.15).otherwise(0.0) + 0.10 * F.regexp_count(F.lower("description"), F.lit("steel|brass")), 6).alias("rank_score")), f"WITH {C_SQL} SELECT mention_id, cand_key, round(score + (CASE WHEN lower(label) = lower(surface) THEN 0.3e0 WHEN contains(lower(label), lower(surface)) THEN 0.15e0 ELSE 0e0 END) + 0.1e0 * len(regexp_extract_all(lower(description), 'steel|brass')), 6) AS rank_score FROM candidates WHERE NOT regexp_matches(description, '(?i)brushed|plated')")
register("T113_T115_entity_ids", lambda s, d: candidates(s, d).select(F.concat_ws(":", F.coalesce("source", F.lit("none")), F.coalesce(F.nullif(F.col("cand_key").cast("string"), F.lit("")), "label")).alias("entity_id")).distinct(), f"WITH {C_SQL} SELECT DISTINCT concat_ws(':', source, cand_key) AS entity_id FROM candidates")
register("W17_query_variants", lambda s, d: pairs(s, d).where(F.length("a") >= 5).select("a", "b", F.array_join(F.array_distinct(F.array(F.concat_ws(" ", "a", "b"), F.col("a"), F.when(F.length("b") >= 5, F.col("b")).otherwise(F.col("a")))), "|").alias("variants")), f"WITH {PAIRS} SELECT a, b, CASE WHEN length(b) >= 5 AND b <> a THEN concat(a, ' ', b, '|', a, '|', b) ELSE concat(a, ' ', b, '|', a) END AS variants FROM pairs WHERE length(a) >= 5")
