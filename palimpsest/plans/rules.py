"""Rules on lines, tokens, labels and hints, each with the SQL of its rule sheet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.functions import text as T
from palimpsest.functions import tokens as K
from palimpsest.plans import sql as Q
from palimpsest.plans.extraction import RECALL, SIGNS, q_matches
from palimpsest.plans.hardening import META, SANITY, language_tokens, text_score, Q_LANG, Q_SCORE
from palimpsest.plans.similarity import plain, q_plain
from palimpsest.plans.store import read
from palimpsest.plans.text_quality import DOCS, documents, per_document, spread
from palimpsest.operators import extraction as X
from palimpsest.operators import spans as N
from palimpsest.registry import register

# ---- fixed values -------------------------------------------------------------------
IMPROBABLE = K.IMPROBABLE
ROMAN, YEAR_LIKE = "(?i)^[MDCLXVI]{2,}$", "(?i)^(anno|an|m[cdxlvi]+)$"
SAFE_CORRECTIONS = {"patru": "patri", "clemencia": "clementia"}
INITIAL_WHITELIST = ["cuero di", "cvero di", "euerendi", "euerendu", "euerendi i", "euerendu i"]
PARTIAL_WARNINGS = "LOW_TEXT_QUALITY INVALID_OCR_JSON JSON_REPAIR_RETRY SCRIPT_DRIFT HALLUCINATION_SUSPECTED OCR_FAILED_ALL_MODELS PROOFREAD_FAILED PROOFREAD_EMPTY_RESULT PROOFREAD_SKIPPED_LOW_QUALITY SEGMENTATION_FAILED".split()
LANGUAGES = "latin old_english middle_english french old_french middle_french anglo_norman occitan old_high_german middle_high_german german dutch italian spanish portuguese catalan church_slavonic greek hebrew arabic mixed unknown".split()
LANGUAGE_CODES = {"la": "latin", "fr": "french", "fro": "old_french", "frm": "middle_french", "enm": "middle_english", "ang": "old_english", "de": "german", "it": "italian", "es": "spanish", "pt": "portuguese", "nl": "dutch", "ca": "catalan", "oc": "occitan", "he": "hebrew", "ar": "arabic", "el": "greek"}
TEXTUAL = ["Main script black", "Main script coloured", "Variant script black", "Variant script coloured", "Page Number", "Quire Mark", "Running header", "Catchword", "Gloss", "MusicLine", "Music"]
INITIALS = ["Historiated", "Inhabited", "Zoo - Anthropomorphic", "Embellished", "Plain initial- coloured", "Plain initial - Highlighted", "Plain initial - Black"]
ILLUSTRATIONS, DIAGRAMS = ["Illustrations"], ["Diagram", "GraphicZone"]
STRUCTURAL = ["Table", "MainZone", "MarginTextZone", "DefaultLine"]
ASKS_TEXT = "(?i)\\b(what does it say|read|transcribe|extract text|page number|number)\\b"
ASKS_LETTER = "(?i)\\b(what letter|which letter|what\\s+is\\b[^?.!\\n]{0,60}\\bletter\\b|identify (the )?letter|identify (the )?initial|which initial|initial letter)\\b"
ASKS_LETTERS = "(?i)\\b(?:what\\s+(?:is|are)|which|identify|list|name)\\b[^?.!\\n]{0,80}\\b(?:letters|initials)\\b"
ASKS_MANY = "(?i)\\b(all|every|each|both|multiple|several|many|these|those|all of|all matched|all regions|all labels)\\b"
ASKS_CONTENT = "(?i)\\b(what does it say|read|transcribe|extract text|what is shown|what do you see|what is visible|describe|what color|drawn|decoration|ornament|image|figure|scene)\\b"
BACKENDS = {
    ("latin",): ["kraken_cremma_lat", "kraken_catmus", "kraken_mccatmus"],
    ("old_french", "middle_french", "anglo_norman", "french"): ["kraken_cremma_medieval", "kraken_catmus", "kraken_mccatmus"],
    ("german", "old_high_german", "middle_high_german", "dutch", "old_dutch", "middle_dutch", "flemish", "english", "old_english", "middle_english"): ["kraken_mccatmus", "kraken_catmus"],
}
OTHER_BACKENDS = ["kraken_catmus", "kraken_mccatmus"]
STAGE_MODELS = {("translation",): ["translator", "rag"], ("label_visual", "visual_label_analysis", "visual_chat"): ["visual", "visual_2", "rag"], ("verification", "verifier", "paleography_verification"): ["verifier", "rag"]}
PLACE_PATTERNS = ["a", "a la", "au", "aux", "as", "en", "vers", "sur", "sor", "de la cite de", "de la ville de", "del pais de", "du pais de", "en la cite de", "en la ville de"]
LOCATIVES = "a au aux en vers sur sor devers lez pres".split()
HEADWORDS = "cite ville castel chastel pais pays terre roiaume reaume contree abbaye monastere eglise diocese".split()
NAMES = "arthur artus artur lancelot lancelo lancelote leantlote lanselot lanceloc guenievre guenievr guenevere perceval parsival percevall merlin merlim galahad galaad tristan tristam gauvain gawain yvain ywain ivain erec enide bohort bors".split()
ECHO_LINES = ["the transcription is:", "strict diplomatic transcription task.", "the text is:", "preserve reading order exactly.", "preserve line breaks exactly.", "output one manuscript line per output line.", "do not normalize spelling.", "do not modernize language.", "do not translate.", "do not explain.", "do not summarize.", "do not invent missing text.", "do not repeat lines.", "preserve punctuation, abbreviations, unusual glyphs, and capitalization exactly as written."]
TRANSLATION_HEAD = "(?i)^\\s*(here(?: is|\\x27s)? (?:the )?translation|translation|tentative translation|english translation|modern english|english rendering|fluent translation|old french to english(?: translation)?)\\s*:\\s*"
TRANSLATION_BODY = "(?i)^\\s*(translation|tentative translation|english translation|modern english|english rendering)\\s*:\\s*"
TRANSLATION_DROPPED = ["user request:", "ocr-extracted source text:", "source text:", "source language:", "target language:", "translation note:", "translator's note:", "metadata:", "context:", "explanation:", "commentary:"]

lit = lambda values: F.array(*[F.lit(v) for v in values])


def looked_up(value: Column, table: dict, other: Column) -> Column:
    """The entry of the key tuple that holds ``value``."""
    out = None
    for keys, found in table.items():
        found = lit(found) if isinstance(found, list) else F.lit(found)
        out = F.when(value.isin(*keys), found) if out is None else out.when(value.isin(*keys), found)
    return out.otherwise(other)


def q_looked_up(value: str, table: dict, other: str) -> str:
    entry = lambda f: Q.array(f) if isinstance(f, list) else f"'{f}'"
    return "CASE " + " ".join(f"WHEN {value} IN {Q.words(keys)} THEN {entry(found)}" for keys, found in table.items()) + f" ELSE {other} END"


# ---- tokens that are masked (T65, T66) ---------------------------------------------------


def suspicious(t: Column) -> Column:
    """Digits beyond Roman and year-like tokens, long tokens with few vowels, improbable bigrams, repeated signs, five consonants in a row."""
    low, n = F.lower(t), T.letters(t)
    digit = t.rlike("[0-9]") & ~t.rlike(ROMAN) & ~t.rlike(YEAR_LIKE) & ~F.regexp_replace(t, r"[^\p{L}]", "").rlike(ROMAN)
    few = (n >= 12) & (T.vowel_ratio(t) < 0.20)
    odd = (n >= 3) & (low.rlike("|".join(IMPROBABLE)) | (low.rlike(r"(.)\1{2,}") & ~t.rlike(ROMAN)))
    return (n > 0) & (digit | few | odd | (low.rlike("[bcdfghjklmnpqrstvwxyz]{5,}") & ~t.rlike(ROMAN)))


def q_suspicious(t: str) -> str:
    n = Q.letters(t)
    tripled = f"len(list_filter(range(1, length({t}) - 1), lambda i: substr(lower({t}), i, 1) = substr(lower({t}), i + 1, 1) AND substr(lower({t}), i, 1) = substr(lower({t}), i + 2, 1))) > 0"
    roman = lambda x: f"regexp_matches({x}, '{ROMAN}')"
    return (
        rf"({n} > 0 AND ((regexp_matches({t}, '[0-9]') AND NOT {roman(t)} AND NOT regexp_matches({t}, '{YEAR_LIKE}') AND NOT {roman(f'regexp_replace({t}, ' + chr(39) + '[^' + chr(92) + 'p{L}]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}) "
        f"OR ({n} >= 12 AND {Q.vowel_ratio(t)} < 0.2e0) OR ({n} >= 3 AND (regexp_matches(lower({t}), '{'|'.join(IMPROBABLE)}') OR ({tripled} AND NOT {roman(t)}))) "
        f"OR (regexp_matches(lower({t}), '[bcdfghjklmnpqrstvwxyz]{{5,}}') AND NOT {roman(t)})))"
    )


gated = lambda r: F.when(T.share_of_lines(T.tokens(r), suspicious) > 0.30, "[…]").otherwise(r)
Q_GATED = f"CASE WHEN {Q.share(f'len(list_filter({Q.tokens('x')}, lambda y: {q_suspicious('y')}))', f'len({Q.tokens('x')})')} > 0.3e0 THEN '[…]' ELSE x END"
per_document(
    "T65_quality_gate_enforce",
    lambda text, toks, rows: {"sha": F.sha2(F.array_join(F.transform(F.split(text, "\n"), gated), "\n"), 256), "masked": F.size(F.filter(F.split(text, "\n"), lambda r: T.share_of_lines(T.tokens(r), suspicious) > 0.30))},
    {"sha": f"sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {Q_GATED}), chr(10)))", "masked": f"len(list_filter(string_split(text, chr(10)), lambda x: {Q.share(f'len(list_filter({Q.tokens('x')}, lambda y: {q_suspicious('y')}))', f'len({Q.tokens('x')})')} > 0.3e0))::INT"},
)


def forced_markers(docs: DataFrame) -> DataFrame:
    """(doc_id, text, forced): a question mark behind the one to three most suspicious tokens of a noisy text without any mark of doubt."""
    return K.by_text(spread(docs.select("doc_id", "text")), "text string, forced long", K.forced_marks, "text")


Q_T_SCORE = f"(CASE WHEN {q_suspicious('t')} THEN 1e0 ELSE 0e0 END + CASE WHEN {Q.letters('t')} >= 6 AND {Q.vowel_ratio('t')} < 0.25e0 THEN 0.5e0 ELSE 0e0 END + CASE WHEN {Q.letters('t')} >= 3 AND regexp_matches(lower(t), '[bcdfghjklmnpqrstvwxyz]{{4,}}') THEN 0.3e0 ELSE 0e0 END)"
register(
    "T66_forced_markers",
    lambda s, d: forced_markers(documents(s, d)).select("doc_id", F.sha2("text", 256).alias("sha"), "forced"),
    f"WITH {SANITY}, noisy AS (SELECT doc_id, marks <= 0 AND (odd > 0.05e0 OR junk > 0.03e0) AS noisy FROM sanity), ln AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS old FROM docs), "
    f"tk AS (SELECT doc_id, line, unnest(range(len({Q.tokens('old')}))) AS pos, unnest({Q.tokens('old')}) AS t FROM ln), sc AS (SELECT *, CASE WHEN t IN ('[…]', '?') THEN 0e0 ELSE {Q_T_SCORE} END AS score FROM tk), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, pos) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM sc WHERE score > 0), ch AS (SELECT rk.doc_id, line, pos FROM rk JOIN noisy USING (doc_id) WHERE noisy AND place <= least(greatest(1, floor(n * 0.1e0)), 3)), "
    "nw AS (SELECT tk.doc_id, tk.line, string_agg(t || CASE WHEN ch.pos IS NULL THEN '' ELSE '?' END, ' ' ORDER BY tk.pos) AS new, count(ch.pos) AS hits FROM tk LEFT JOIN ch ON ch.doc_id = tk.doc_id AND ch.line = tk.line AND ch.pos = tk.pos GROUP BY 1, 2 HAVING count(ch.pos) > 0), "
    f"sm AS (SELECT DISTINCT doc_id, true AS scored FROM rk), w AS (SELECT ln.doc_id, ln.line, old, new, coalesce(hits, 0) AS hits, noisy AND scored IS NULL AND ln.line = max(ln.line) OVER (PARTITION BY ln.doc_id) AS bare FROM ln LEFT JOIN nw ON nw.doc_id = ln.doc_id AND nw.line = ln.line JOIN noisy ON noisy.doc_id = ln.doc_id LEFT JOIN sm ON sm.doc_id = ln.doc_id) "
    f"SELECT doc_id, sha256(string_agg(CASE WHEN new IS NOT NULL THEN new WHEN bare THEN regexp_replace(old, '{Q.WS}+$', '') || ' [?]' ELSE old END, chr(10) ORDER BY line)) AS sha, sum(hits + bare::INT)::BIGINT AS forced FROM w GROUP BY 1",
)

# ---- lines (T63, T67, T82, T85) ------------------------------------------------------------

META_PATTERNS = "i[' ]?m sorry|cannot transcribe|unclear image|not clear enough|as an ai"
OTHER_SCRIPTS = "\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}"
is_meta = lambda r: F.lower(r).rlike(f"(^|[^\\p{{L}}\\p{{N}}_])({META_PATTERNS})([^\\p{{L}}\\p{{N}}_]|$)")
Q_IS_META = f"regexp_matches(lower(x), '(^|[^\\p{{L}}\\p{{N}}_])({META_PATTERNS.replace(chr(39), chr(39) * 2)})([^\\p{{L}}\\p{{N}}_]|$)')"


def latin_line(r: Column) -> Column:
    """Control signs go, gaps are written alike, long runs of question marks are gaps, letters of other scripts question marks."""
    r = F.regexp_replace(r, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for old, new in (("[...]", "[…]"), ("...", "[…]"), ("…", "[…]"), ("[[…]]", "[…]")):
        r = F.replace(r, F.lit(old), F.lit(new))
    return T.collapse(F.regexp_replace(F.regexp_replace(r, r"\?{6,}", "[…]"), f"[{OTHER_SCRIPTS}]", "?"))


Q_LATIN = r"regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
for _old, _new in (("[...]", "[…]"), ("...", "[…]"), ("…", "[…]"), ("[[…]]", "[…]")):
    Q_LATIN = f"replace({Q_LATIN}, '{_old}', '{_new}')"
Q_LATIN = f"regexp_replace({Q.strip(f'regexp_replace(regexp_replace({Q_LATIN}, ' + chr(39) + chr(92) + '?{6,}' + chr(39) + ', ' + chr(39) + '[…]' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + f'), ' + chr(39) + f'[{OTHER_SCRIPTS}]' + chr(39) + ', ' + chr(39) + '?' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{Q.WS}+', ' ', 'g')"


def pattern_junk(line: Column) -> Column:
    """A known mark, only question marks, seven equal signs in a row, or ten signs and more of at most two letters."""
    low = F.lower(T.strip(line))
    letters = F.array_distinct(F.filter(F.split(low, ""), lambda c: c.rlike(r"\p{L}")))
    return low.contains("ccooocoo") | low.rlike(r"^\?{6,}$") | low.rlike(r"(.)\1{6,}") | ((F.length(F.regexp_replace(low, f"{T.SPACE}+", "")) >= 10) & (F.size(letters) <= 2))


def q_pattern_junk(x: str) -> str:
    low = f"lower({Q.strip(x)})"
    return rf"(contains({low}, 'ccooocoo') OR regexp_matches({low}, '^\?{{6,}}$') OR len(list_filter(list_distinct(string_split({low}, '')), lambda c: contains({low}, repeat(c, 7)))) > 0 OR (length(regexp_replace({low}, '{Q.WS}+', '', 'g')) >= 10 AND len(list_distinct(regexp_extract_all({low}, '\p{{L}}'))) <= 2))"


def kept_lines(docs: DataFrame) -> DataFrame:
    """Kept lines of a text, how many went for which reason, and the share of signs of other scripts."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("meta", is_meta(F.col("raw"))).withColumn("new", latin_line(F.col("raw")))
    lines = lines.withColumn("odd", F.length("raw") - F.length(F.regexp_replace("raw", f"[{OTHER_SCRIPTS}]", ""))).withColumn("junk", ~F.col("meta") & (F.col("new") != "") & pattern_junk(F.col("new")))
    ok = ~F.col("meta") & (F.col("new") != "") & ~F.col("junk")
    size = F.when(~F.col("meta"), F.greatest(F.lit(1), F.length("new"))).otherwise(0)
    out = lines.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct("line", "new")))).alias("kept"), F.count(F.when(F.col("meta"), 1)).alias("meta_text_removed"), F.count(F.when(F.col("junk"), 1)).alias("pattern_junk_removed"),
        F.round(F.sum(F.when(~F.col("meta"), F.col("odd")).otherwise(0)) / F.greatest(F.lit(1), F.sum(size)), 6).alias("replaced"),
    )
    return out.select("doc_id", F.size("kept").alias("lines"), F.sha2(F.array_join(F.col("kept.new"), "\n"), 256).alias("sha"), "meta_text_removed", "pattern_junk_removed", "replaced")


register(
    "T63_normalized_lines",
    lambda s, d: kept_lines(documents(s, d)),
    f"WITH {DOCS}, l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS x FROM docs), m AS (SELECT *, {Q_IS_META} AS meta, {Q_LATIN} AS new, length(x) - length(regexp_replace(x, '[{OTHER_SCRIPTS}]', '', 'g')) AS odd FROM l), "
    f"j AS (SELECT *, NOT meta AND new <> '' AND {q_pattern_junk('new')} AS junk FROM m) SELECT doc_id, count(*) FILTER (NOT meta AND new <> '' AND NOT junk)::INT AS lines, sha256(coalesce(string_agg(new, chr(10) ORDER BY line) FILTER (NOT meta AND new <> '' AND NOT junk), '')) AS sha, count(*) FILTER (meta) AS meta_text_removed, count(*) FILTER (junk) AS pattern_junk_removed, "
    "round(sum(CASE WHEN meta THEN 0 ELSE odd END)::DOUBLE / greatest(1, sum(CASE WHEN meta THEN 0 ELSE greatest(1, length(new)) END)), 6) AS replaced FROM j GROUP BY 1",
)


def repaired(docs: DataFrame) -> DataFrame:
    """A text given as items of two lines each: items are split, the text rebuilt from them, warnings told."""
    raw = F.split("text", "\n")
    items = F.transform(F.sequence(F.lit(0), F.floor((F.size("raw") - 1) / 2)), lambda i: F.array_join(F.slice("raw", i * 2 + 1, 2), "\n"))
    base = docs.withColumn("raw", raw).withColumn("items", items)
    lines = F.filter(F.flatten(F.transform("items", lambda x: F.transform(F.split(x, "\n"), T.strip))), lambda x: x != "")
    base = base.withColumn("lines", lines).withColumn("joined", T.strip(F.array_join("lines", "\n")))
    warnings = F.array_compact(F.array(F.when(F.exists("items", lambda x: x.contains("\n")), "repair:lines_split_embedded_newlines"), F.when(T.strip("text") != F.col("joined"), "TEXT_JOIN_FIXED")))
    return base.select("doc_id", F.size("lines").alias("lines"), F.sha2("joined", 256).alias("sha"), F.array_join(warnings, ",").alias("warnings"))


register(
    "T67_repaired_lines",
    lambda s, d: repaired(documents(s, d)),
    f"WITH {DOCS}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '') AS ls FROM docs) SELECT doc_id, len(ls)::INT AS lines, sha256({Q.strip('coalesce(array_to_string(ls, chr(10)), ' + chr(39) * 2 + ')')}) AS sha, "
    f"concat_ws(',', CASE WHEN len(raw) >= 2 THEN 'repair:lines_split_embedded_newlines' END, CASE WHEN {Q.strip('text')} <> {Q.strip('coalesce(array_to_string(ls, chr(10)), ' + chr(39) * 2 + ')')} THEN 'TEXT_JOIN_FIXED' END) AS warnings FROM l",
)


def translation(text: Column) -> Column:
    """A model's translation without its chatter: heads, notes and remarks on the page go; [unclear] if nothing is left."""
    raw = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n")
    bare = F.transform(raw, lambda x: F.regexp_replace(T.strip(x), '^"+|"+$', ""))
    clean = F.transform(F.filter(bare, lambda x: x != ""), lambda x: T.strip(F.regexp_replace(T.strip(F.regexp_replace(x, "(?i)```(?:json)?", " ")), TRANSLATION_HEAD, "")))
    starts = "^(" + "|".join(x.replace("'", "\\x27") for x in TRANSLATION_DROPPED) + ")"
    kept = F.filter(clean, lambda x: ~F.lower(x).rlike(starts) & ~(x.rlike("(?i)^(the|this)\\s+(page|image|manuscript)\\b") & (F.size(raw) > 1)))
    body = T.strip(F.regexp_replace(T.collapse(F.array_join(kept, " ")), TRANSLATION_BODY, ""))
    body = T.strip(F.regexp_replace(body, "(?i)\\s+\\bnote:\\s+.*$", ""))
    body = T.strip(F.regexp_replace(body, "(?i)\\s+\\btranslator\\x27?s note:\\s+.*$", ""))
    return F.when(body == "", "[unclear]").otherwise(body)


def q_translation(text: str) -> str:
    clean = f"list_transform(list_filter(list_transform(raw, lambda x: regexp_replace({Q.strip('x')}, '^\"+|\"+$', '', 'g')), lambda x: x <> ''), lambda x: {Q.strip('regexp_replace(' + Q.strip('regexp_replace(x, ' + chr(39) + '(?i)```(?:json)?' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')') + ', ' + chr(39) + TRANSLATION_HEAD + chr(39) + ', ' + chr(39) * 2 + ')')})"
    starts = "^(" + "|".join(x.replace("'", "\\x27") for x in TRANSLATION_DROPPED) + ")"
    kept = f"list_filter({clean}, lambda x: NOT regexp_matches(lower(x), '{starts}') AND NOT (regexp_matches(x, '(?i)^(the|this)\\s+(page|image|manuscript)\\b') AND len(raw) > 1))"
    body = f"regexp_replace({Q.strip(f'coalesce(array_to_string({kept}, ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) * 2 + ')')}, '{Q.WS}+', ' ', 'g')"
    for pattern in (TRANSLATION_BODY, "(?i)\\s+\\bnote:\\s+.*$", "(?i)\\s+\\btranslator\\x27?s note:\\s+.*$"):
        body = Q.strip(f"regexp_replace({body}, '{pattern}', '')")
    return body


chatty = lambda: F.concat(F.lit("Here is the translation: "), F.replace("text", F.lit("\n"), F.lit("\nContext: x\n\"The page\" shows\nThis page has\n")), F.lit(" Note: uncertain"))
register(
    "T82_translation_output",
    lambda s, d: documents(s, d).select("doc_id", chatty().alias("text")).select("doc_id", F.sha2(translation(F.col("text")), 256).alias("sha")),
    f"WITH {DOCS}, c AS (SELECT doc_id, concat('Here is the translation: ', replace(text, chr(10), chr(10) || 'Context: x' || chr(10) || '\"The page\" shows' || chr(10) || 'This page has' || chr(10)), ' Note: uncertain') AS text FROM docs), r AS (SELECT doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) AS raw FROM c), b AS (SELECT doc_id, {q_translation('text')} AS body FROM r) SELECT doc_id, sha256(CASE WHEN body = '' THEN '[unclear]' ELSE body END) AS sha FROM b",
)


def direct_text(label: Column, raw: Column) -> Column:
    """Lines without echoes of the prompt; of short marks the whole if it is short, else the first code in it."""
    lines = F.filter(F.transform(F.split(F.replace(raw, F.lit("\r"), F.lit("\n")), "\n"), T.strip), lambda x: x != "")
    lines = F.filter(lines, lambda x: ~F.lower(x).isin(*ECHO_LINES) & ~F.lower(x).startswith("if a character or word is unclear"))
    compact = T.strip(F.array_join(lines, " "))
    code = F.regexp_extract(compact, r"(?:^|[^A-Za-z0-9_])([0-9]{1,4}|[IVXLCDM]{1,8}|[A-Za-z]{1,4}[0-9]{0,3})(?:[^A-Za-z0-9_]|$)", 1)
    mark = label.isin("Page Number", "Quire Mark", "Running header", "Catchword")
    return F.when(mark & (compact != "") & (F.size(lines) <= 2) & (F.length(compact) <= 24), compact).when(mark & (code != ""), code).otherwise(F.array_join(lines, "\n"))


LABELS = TEXTUAL + INITIALS + ILLUSTRATIONS + DIAGRAMS + STRUCTURAL
label_of = lambda key: F.element_at(lit(LABELS), (key % len(LABELS) + 1).cast("int"))
q_label_of = lambda key: f"{Q.array(LABELS)}[({key} % {len(LABELS)} + 1)::INT]"
echoed = lambda: F.concat(F.lit("The text is:\n"), plain(F.col("text")), F.lit("\r\nDo not translate.\n"))
Q_CODE = r"'(?:^|[^A-Za-z0-9_])([0-9]{1,4}|[IVXLCDM]{1,8}|[A-Za-z]{1,4}[0-9]{0,3})(?:[^A-Za-z0-9_]|$)'"
register(
    "T85_direct_text",
    lambda s, d: documents(s, d).select("doc_id", label_of(F.col("doc_id")).alias("label"), echoed().alias("raw")).select("doc_id", "label", F.sha2(direct_text(F.col("label"), F.col("raw")), 256).alias("sha")),
    f"WITH {DOCS}, r AS (SELECT doc_id, {q_label_of('doc_id')} AS label, concat('The text is:', chr(10), {q_plain('text')}, chr(13), chr(10), 'Do not translate.', chr(10)) AS raw FROM docs), "
    f"l AS (SELECT doc_id, label, list_filter(list_transform(string_split(replace(raw, chr(13), chr(10)), chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '' AND lower(x) NOT IN {Q.words(ECHO_LINES)} AND NOT starts_with(lower(x), 'if a character or word is unclear')) AS ls FROM r), "
    f"c AS (SELECT *, {Q.strip('coalesce(array_to_string(ls, ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) * 2 + ')')} AS compact, label IN ('Page Number', 'Quire Mark', 'Running header', 'Catchword') AS mark FROM l) "
    f"SELECT doc_id, label, sha256(CASE WHEN mark AND compact <> '' AND len(ls) <= 2 AND length(compact) <= 24 THEN compact WHEN mark AND regexp_extract(compact, {Q_CODE}, 1) <> '' THEN regexp_extract(compact, {Q_CODE}, 1) ELSE coalesce(array_to_string(ls, chr(10)), '') END) AS sha FROM c",
)

# ---- safe corrections (T77, T78, T105, T106, T107) ----------------------------------------------

CORRECTED = r"[A-Za-z][A-Za-z'’\\\-]*"
name_like = lambda t: (F.length(t) >= 18) | F.substring(t, 2, 1000).rlike(r"\p{Lu}")


def cased(template: Column, replacement: Column) -> Column:
    """The replacement in capitals, capitalised or as it is, as the template is."""
    rest = F.substring(template, 2, 1000)
    upper = (template == F.upper(template)) & (template != F.lower(template))
    capital = template.rlike(r"^\p{Lu}") & (rest == F.lower(rest)) & (rest != F.upper(rest))
    return F.when(upper, F.upper(replacement)).when(capital, F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, 2, 1000)))).otherwise(replacement)


def q_cased(t: str, r: str) -> str:
    rest = f"substr({t}, 2)"
    return rf"CASE WHEN {t} = upper({t}) AND {t} <> lower({t}) THEN upper({r}) WHEN regexp_matches({t}, '^\p{{Lu}}') AND {rest} = lower({rest}) AND {rest} <> upper({rest}) THEN upper(substr({r}, 1, 1)) || lower(substr({r}, 2)) ELSE {r} END"


def corrected(text: Column) -> Column:
    """Safe corrections of whole tokens, case kept; tokens like names stay, and everything between tokens."""
    fixed = F.create_map(*[F.lit(x) for kv in SAFE_CORRECTIONS.items() for x in kv])
    new = lambda t: F.when(name_like(t) | F.try_element_at(fixed, F.lower(t)).isNull(), t).otherwise(cased(t, F.try_element_at(fixed, F.lower(t))))
    gaps, tokens = F.split(text, CORRECTED, -1), F.regexp_extract_all(text, F.lit(f"({CORRECTED})"), F.lit(1))
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(new(t), F.lit("")))), "")


def initial_fixed(text: Column) -> Column:
    """A decorated initial alone on the first line joins the word that it begins."""
    lines = F.split(text, "\n")
    first, second = T.strip(lines[0]), T.strip(F.try_element_at(lines, F.lit(2)))
    low, rest = T.collapse(F.lower(second)), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(1)))
    alone = (F.size(lines) >= 2) & first.rlike("^[A-Z]$")
    listed = alone & (F.length(second) <= 12) & low.isin(*INITIAL_WHITELIST)
    joined = F.concat(first, F.regexp_replace(F.try_element_at(lines, F.lit(2)), f"^{T.SPACE}+", ""))
    again = lambda head: F.array_join(F.concat(F.array(head), F.filter(rest, lambda x, i: i < F.size(lines) - 2)), "\n")
    return F.when(listed, again(F.lit("Reuerendi"))).when(alone & low.startswith("euer"), again(joined)).otherwise(text)


def q_initial(x: str) -> str:
    ls = f"string_split({x}, chr(10))"
    second = Q.strip(f"{ls}[2]")
    low = f"regexp_replace(lower({second}), '{Q.WS}+', ' ', 'g')"
    alone = f"(len({ls}) >= 2 AND regexp_matches({Q.strip(f'{ls}[1]')}, '^[A-Z]$'))"
    return f"CASE WHEN {alone} AND length({second}) <= 12 AND {low} IN {Q.words(INITIAL_WHITELIST)} THEN array_to_string(list_concat(['Reuerendi'], {ls}[3:]), chr(10)) WHEN {alone} AND starts_with({low}, 'euer') THEN array_to_string(list_concat([{Q.strip(f'{ls}[1]')} || regexp_replace({ls}[2], '^{Q.WS}+', '')], {ls}[3:]), chr(10)) ELSE {x} END"


def q_corrected(x: str) -> str:
    p = CORRECTED.replace("'", "''")
    fixed = lambda t: f"CASE lower({t}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SAFE_CORRECTIONS.items()) + " END"
    new = rf"CASE WHEN length(t) >= 18 OR regexp_matches(substr(t, 2), '\p{{Lu}}') OR {fixed('t')} IS NULL THEN t ELSE {q_cased('t', fixed('t'))} END"
    return f"(SELECT coalesce(string_agg(gap || CASE WHEN t IS NULL THEN '' ELSE {new} END, '' ORDER BY i), '') FROM (SELECT unnest(string_split_regex({x}, '{p}')) AS gap, unnest(list_concat(regexp_extract_all({x}, '{p}'), [NULL])) AS t, unnest(range(len(string_split_regex({x}, '{p}')))) AS i))"


worn = lambda: F.concat(F.when(F.col("doc_id") % 3 == 0, "R\n euerendi \n").when(F.col("doc_id") % 3 == 1, "R\n  euerend pere\n").otherwise(""), F.replace(F.replace(plain(F.col("text")), F.lit("er "), F.lit(" patru ")), F.lit("The "), F.lit("Patru clemencia CLEMENCIA ")))
Q_WORN = f"concat(CASE doc_id % 3 WHEN 0 THEN 'R' || chr(10) || ' euerendi ' || chr(10) WHEN 1 THEN 'R' || chr(10) || '  euerend pere' || chr(10) ELSE '' END, replace(replace({q_plain('text')}, 'er ', ' patru '), 'The ', 'Patru clemencia CLEMENCIA '))"
register(
    "T77_T78_T105_T107_safe_normalizer",
    lambda s, d: documents(s, d).select("doc_id", worn().alias("text")).select("doc_id", F.sha2(corrected(F.col("text")), 256).alias("corrected"), F.sha2(corrected(initial_fixed(F.col("text"))), 256).alias("normalized")),
    f"WITH {DOCS}, w AS (SELECT doc_id, {Q_WORN} AS text FROM docs), i AS (SELECT doc_id, text, {q_initial('text')} AS fixed FROM w) SELECT doc_id, sha256({q_corrected('text')}) AS corrected, sha256({q_corrected('fixed')}) AS normalized FROM i",
)
register(
    "T106_apply_case",
    lambda s, d: documents(s, d).select(F.explode(T.tokens(plain(F.col("text")))).alias("token")).distinct().select("token", cased(F.col("token"), F.reverse(F.lower("token"))).alias("cased")),
    f"WITH {DOCS}, tok AS (SELECT DISTINCT unnest({Q.tokens(q_plain('text'))}) AS token FROM docs) SELECT token, {q_cased('token', 'reverse(lower(token))')} AS cased FROM tok",
)

# ---- language views and codes (T57, T69, T72) -----------------------------------------------------


def langid_text(text: Column) -> Column:
    """What language identification sees: letters of word-like tokens; nothing below 50 letters."""
    value = F.translate(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" et ")), r"\[(?:…|\.\.\.)\]", " "), "?ſ", " s")
    good = F.filter(T.tokens(value), lambda w: (T.letters(w) > 0) & ((F.length(w) - T.letters(w)) / F.length(w) <= 0.5))
    bare = F.transform(good, lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    kept = F.filter(bare, lambda w: ~((F.length(w) >= 4) & w.rlike("^[A-Za-zÀ-ÖØ-öø-ÿĀ-žſƀ-ɏ]+$") & (T.vowel_ratio(w) < 0.20)))
    clean = F.lower(F.array_join(kept, " "))
    return F.when(F.regexp_count(clean, F.lit("[A-Za-zÀ-ÖØ-öø-ÿĀ-žſƀ-ɏ]")) < 50, "").otherwise(clean)


Q_LANGID_VALUE = r"translate(regexp_replace(replace(text, '&', ' et '), '\[(?:…|\.\.\.)\]', ' ', 'g'), '?ſ', ' s')"
Q_LANGID = (
    rf"lower(coalesce(array_to_string(list_filter(list_transform(list_filter({Q.tokens(Q_LANGID_VALUE)}, lambda x: {Q.letters('x')} > 0 AND (length(x) - {Q.letters('x')})::DOUBLE / length(x) <= 0.5e0), lambda x: regexp_replace(x, '[^\p{{L}}]', '', 'g')), "
    rf"lambda x: NOT (length(x) >= 4 AND regexp_matches(x, '^[A-Za-zÀ-ÖØ-öø-ÿĀ-žſƀ-ɏ]+$') AND {Q.vowel_ratio('x')} < 0.2e0)), ' '), ''))"
)
register(
    "T69_langid_text",
    lambda s, d: documents(s, d).select("doc_id", F.sha2(langid_text(F.col("text")), 256).alias("sha")),
    f"WITH {DOCS}, c AS (SELECT doc_id, {Q_LANGID} AS clean FROM docs) SELECT doc_id, sha256(CASE WHEN len(regexp_extract_all(clean, '[A-Za-zÀ-ÖØ-öø-ÿĀ-žſƀ-ɏ]')) < 50 THEN '' ELSE clean END) AS sha FROM c",
)
per_document("T104_language_tokens", lambda text, toks, rows: {"tokens": F.size(language_tokens(toks)), "sha": F.sha2(F.array_join(language_tokens(toks), " "), 256)}, {"tokens": f"len({Q_LANG})::INT", "sha": f"sha256(coalesce(array_to_string({Q_LANG}, ' '), ''))"})


def language_code(value: Column) -> Column:
    clean = F.regexp_replace(F.lower(T.strip(F.coalesce(value, F.lit("unknown")))), "[- ]", "_")
    full = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv]), clean), clean)
    return F.when(full.isin(*LANGUAGES), full).otherwise("unknown")


Q_CODE_OF = "(CASE v " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGE_CODES.items()) + " ELSE v END)"
SAMPLES = [*LANGUAGE_CODES, *LANGUAGES, "Old French", " church-slavonic ", "klingon", "LA", ""]
sample = lambda values, key: F.element_at(lit(values), (key % len(values) + 1).cast("int"))
q_sample = lambda values, key: f"{Q.array(values)}[({key} % {len(values)} + 1)::INT]"
register("T72_T98_language_code", lambda s, d: read(s, d, "events").select("event_id", language_code(sample(SAMPLES, F.col("event_id"))).alias("language")), f"WITH v AS (SELECT event_id, regexp_replace(lower(trim({q_sample(SAMPLES, 'event_id')})), '[- ]', '_', 'g') AS v FROM events) SELECT event_id, CASE WHEN {Q_CODE_OF} IN {Q.words(LANGUAGES)} THEN {Q_CODE_OF} ELSE 'unknown' END AS language FROM v")


def region_quality(docs: DataFrame) -> DataFrame:
    """0.25 confidence + 0.45 text + 0.30 lexical score, times 0.65 if eight signs and more are implausible."""
    t = docs.withColumn("t", T.strip("text")).withColumn("language", F.when(F.col("lang") == "fr", "french").when(F.col("lang") == "es", "spanish").otherwise("unknown"))
    t = t.withColumn("lexical", T.lexical_plausibility(F.col("text"), F.col("language"))).withColumn("confidence", F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(F.least(F.lit(1.0), F.col("doc_id") % 13 / 10)))
    mean = 0.25 * F.col("confidence") + 0.45 * text_score(F.col("t"), T.lines("t")) + 0.30 * F.col("lexical")
    bad = (F.length(F.regexp_replace("text", f"{T.SPACE}+", "")) >= 8) & (F.col("lexical") < 0.25)
    return t.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(bad, mean * 0.65).otherwise(mean))), 4).alias("quality"))


register(
    "T57_region_quality",
    lambda s, d: region_quality(documents(s, d)),
    rf"WITH {DOCS}, w AS (SELECT doc_id, lang, regexp_replace(lower(unnest({Q.tokens('text')})), '[^\p{{L}}]', '', 'g') AS w FROM docs), tri AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS t FROM w WHERE length(w) >= 3), "
    f"h AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((lang = 'fr' AND t IN {Q.words(C.TRIGRAMS['french'])}) OR (lang = 'es' AND t IN {Q.words(C.TRIGRAMS['latin'])})) AS hits FROM tri GROUP BY doc_id), "
    f"p AS (SELECT d.doc_id, d.text, {Q.strip('d.text')} AS t, CASE WHEN d.lang NOT IN ('fr', 'es') OR h.n IS NULL THEN 0.5e0 ELSE least(1e0, h.hits::DOUBLE / h.n / 0.55e0) END AS lex, CASE WHEN d.doc_id % 7 = 0 THEN 0.5e0 ELSE least(1e0, (d.doc_id % 13)::DOUBLE / 10) END AS conf FROM docs d LEFT JOIN h USING (doc_id)), "
    f"q AS (SELECT doc_id, text, lex, 0.25e0 * conf + 0.45e0 * {Q_SCORE} + 0.3e0 * lex AS mean FROM p) SELECT doc_id, round(greatest(0e0, least(1e0, CASE WHEN length(regexp_replace(text, '{Q.WS}+', '', 'g')) >= 8 AND lex < 0.25e0 THEN mean * 0.65e0 ELSE mean END)), 4) AS quality FROM q",
)

# ---- routing by label, stage, language and hint (P15, P25, P27, P28, P42, P44, P45, P49, W24, C10) -------

WARNINGS = ["", "script_drift", "NOTE,PROOFREAD_EMPTY_RESULT", "note", "LOW_TEXT_QUALITY"]
register(
    "P15_page_status",
    lambda s, d: documents(s, d).select("doc_id", F.when(F.length(T.strip("text")) == 0, "EMPTY").when(F.arrays_overlap(F.split(F.upper(sample(WARNINGS, F.col("doc_id"))), ","), lit(PARTIAL_WARNINGS)), "PARTIAL").when(F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 11 / 10) < 0.4, "PARTIAL").otherwise("FULL").alias("status")),
    f"WITH {DOCS} SELECT doc_id, CASE WHEN length({Q.strip('text')}) = 0 THEN 'EMPTY' WHEN list_has_any(string_split(upper({q_sample(WARNINGS, 'doc_id')}), ','), {Q.array(PARTIAL_WARNINGS)}) THEN 'PARTIAL' WHEN doc_id % 6 <> 0 AND (doc_id % 11)::DOUBLE / 10 < 0.4e0 THEN 'PARTIAL' ELSE 'FULL' END AS status FROM docs",
)
ASKED = ["What letter is this?", "Which initials are there?", "Read all of these letters", "Describe the scene", "What is the page number?", "Why?", ""]


def routing(label: Column, question: Column) -> list[Column]:
    asks = lambda p: question.rlike(p)
    textual, visual, initial = label.isin(*TEXTUAL), label.isin(*INITIALS, *ILLUSTRATIONS, *DIAGRAMS), label.isin(*INITIALS)
    family = F.when(textual, "textual").when(visual, "visual").otherwise("structural")
    many = asks(ASKS_LETTERS) | (asks(ASKS_MANY) & asks(ASKS_LETTER))
    mode = (
        F.when(textual & asks(ASKS_TEXT), "textual_reading").when(textual, "textual_explanation").when(initial & many, "multi_initial_letter_identification").when(initial & asks(ASKS_LETTER), "initial_letter_identification")
        .when(initial, "decorated_initial_analysis").when(label.isin(*ILLUSTRATIONS), "illustration_analysis").when(label.isin(*DIAGRAMS), "diagrammatic_analysis").when(visual, "visual_analysis")
        .when(asks(ASKS_TEXT), "structural_text_assist").otherwise("structural_analysis")
    )
    content = asks(ASKS_CONTENT) & ~asks(ASKS_TEXT)
    direct = ~visual & asks(ASKS_TEXT)
    return [family.alias("family"), mode.alias("submode"), (textual | direct).alias("ocr"), direct.alias("direct"), (visual | (~textual & content)).alias("vision"), F.when(textual, ~asks(ASKS_TEXT)).when(visual, True).otherwise(content).alias("model")]


def q_routing() -> str:
    asks = lambda p: f"regexp_matches(question, '{p}')"
    textual, visual, initial = f"label IN {Q.words(TEXTUAL)}", f"label IN {Q.words(INITIALS + ILLUSTRATIONS + DIAGRAMS)}", f"label IN {Q.words(INITIALS)}"
    many, text, content = f"({asks(ASKS_LETTERS)} OR ({asks(ASKS_MANY)} AND {asks(ASKS_LETTER)}))", asks(ASKS_TEXT), f"({asks(ASKS_CONTENT)} AND NOT {asks(ASKS_TEXT)})"
    return (
        f"CASE WHEN {textual} THEN 'textual' WHEN {visual} THEN 'visual' ELSE 'structural' END AS family, CASE WHEN {textual} AND {text} THEN 'textual_reading' WHEN {textual} THEN 'textual_explanation' WHEN {initial} AND {many} THEN 'multi_initial_letter_identification' WHEN {initial} AND {asks(ASKS_LETTER)} THEN 'initial_letter_identification' "
        f"WHEN {initial} THEN 'decorated_initial_analysis' WHEN label IN {Q.words(ILLUSTRATIONS)} THEN 'illustration_analysis' WHEN label IN {Q.words(DIAGRAMS)} THEN 'diagrammatic_analysis' WHEN {text} THEN 'structural_text_assist' ELSE 'structural_analysis' END AS submode, "
        f"{textual} OR (NOT {visual} AND {text}) AS ocr, NOT {visual} AND {text} AS direct, {visual} OR (NOT {textual} AND {content}) AS vision, CASE WHEN {textual} THEN NOT {text} WHEN {visual} THEN true ELSE {content} END AS model"
    )


register(
    "P25_P45_label_routing",
    lambda s, d: read(s, d, "events").select("event_id", label_of(F.col("event_id")).alias("label"), sample(ASKED, F.col("user_id")).alias("question")).select("event_id", "label", *routing(F.col("label"), F.col("question"))),
    f"WITH r AS (SELECT event_id, {q_label_of('event_id')} AS label, {q_sample(ASKED, 'user_id')} AS question FROM events) SELECT event_id, label, {q_routing()} FROM r",
)
CHOICES = ["auto", "", "Kraken_Catmus", "glm"]
HINTS = ["latin", "french", "middle_french", "german", "dutch", "english", "spanish", "occitan", "unknown"]


def backend_plan(explicit: Column, hint: Column, compare: Column) -> list[Column]:
    """An explicit backend alone, else the order of the language; comparisons that are not tried anyway."""
    chosen = F.lower(T.strip(explicit))
    tried = F.when(chosen.isin("", "auto"), looked_up(hint, BACKENDS, lit(OTHER_BACKENDS))).otherwise(F.array(chosen))
    return [tried[0].alias("primary"), F.array_join(tried, ",").alias("attempts"), F.array_join(F.array_except(compare, tried), ",").alias("comparisons")]


Q_TRIED = f"CASE WHEN lower(c) IN ('', 'auto') THEN {q_looked_up('h', BACKENDS, Q.array(OTHER_BACKENDS))} ELSE [lower(c)] END"
register(
    "P27_backend_plan",
    lambda s, d: read(s, d, "events").select("event_id", *backend_plan(sample(CHOICES, F.col("event_id")), sample(HINTS, F.col("user_id")), lit(["kraken_catmus", "glm", "glm"]))),
    f"WITH e AS (SELECT event_id, {q_sample(CHOICES, 'event_id')} AS c, {q_sample(HINTS, 'user_id')} AS h FROM events), t AS (SELECT event_id, {Q_TRIED} AS t FROM e) SELECT event_id, t[1] AS \"primary\", array_to_string(t, ',') AS attempts, array_to_string(list_filter(['kraken_catmus', 'glm'], lambda x: NOT list_contains(t, x)), ',') AS comparisons FROM t",
)
STAGES = ["translation", "Visual_Chat", "verifier", "rag_chat", "", "label_visual"]
STAGE_OTHER = (["rag"], ["rag", "visual", "visual_2"])
register(
    "P28_fallback_models",
    lambda s, d: read(s, d, "events").select("event_id", F.array_join(F.array_distinct(looked_up(F.lower(T.strip(sample(STAGES, F.col("event_id")))), STAGE_MODELS, F.when(F.col("user_id") % 2 == 0, lit(STAGE_OTHER[1])).otherwise(lit(STAGE_OTHER[0])))), ",").alias("models")),
    f"WITH e AS (SELECT event_id, user_id, lower({q_sample(STAGES, 'event_id')}) AS s FROM events) SELECT event_id, array_to_string({q_looked_up('s', STAGE_MODELS, f'(CASE WHEN user_id % 2 = 0 THEN {Q.array(STAGE_OTHER[1])} ELSE {Q.array(STAGE_OTHER[0])} END)')}, ',') AS models FROM e",
)
VALUES = [" Latin_Medieval", "insular_old_english", "Greek", "unknown", "latin", "mixed ", "supported", "Unsupported", "partially_supported", "unavailable", "maybe", ""]
allowed = lambda v, ok, other: F.when(v.isin(*ok), v).otherwise(other)
SCRIPTS, PAGE_SCRIPTS, ASSESSMENTS = ["insular_old_english", "latin_medieval", "unknown"], ["latin", "greek", "cyrillic", "mixed", "unknown"], ["supported", "partially_supported", "unsupported", "unavailable"]


def allowed_values(s, d):
    v = F.col("v")
    page = F.when(v == "latin_medieval", "latin").otherwise(allowed(v, PAGE_SCRIPTS, "unknown"))
    return read(s, d, "events").select("event_id", F.lower(T.strip(sample(VALUES, F.col("event_id")))).alias("v")).select("event_id", allowed(v, SCRIPTS, "unknown").alias("script"), (~v.isin(*SCRIPTS)).alias("script_changed"), page.alias("page_script"), allowed(v, ASSESSMENTS, "partially_supported").alias("assessment"))


register(
    "P42_P44_P49_allowed_values",
    allowed_values,
    f"WITH e AS (SELECT event_id, lower(trim({q_sample(VALUES, 'event_id')})) AS v FROM events) SELECT event_id, CASE WHEN v IN {Q.words(SCRIPTS)} THEN v ELSE 'unknown' END AS script, v NOT IN {Q.words(SCRIPTS)} AS script_changed, CASE WHEN v = 'latin_medieval' THEN 'latin' WHEN v IN {Q.words(PAGE_SCRIPTS)} THEN v ELSE 'unknown' END AS page_script, CASE WHEN v IN {Q.words(ASSESSMENTS)} THEN v ELSE 'partially_supported' END AS assessment FROM e",
)
register(
    "W24_model_choice",
    lambda s, d: read(s, d, "part").groupBy(F.col("p_size").alias("host")).agg(F.collect_set(F.regexp_extract("p_type", "([^ ]+)$", 1)).alias("available")).select("host", F.array_join(F.filter(lit(["tin", "BRASS", "gold", "Brass", "steel"]), lambda m: F.exists("available", lambda a: F.lower(a) == F.lower(m))), ",").alias("m")).select("host", F.array_join(F.array_distinct(F.split(F.upper("m"), ",")), ",").alias("models")),
    "WITH h AS (SELECT p_size AS host, list(DISTINCT regexp_extract(p_type, '([^ ]+)$', 1)) AS a FROM part GROUP BY 1) SELECT host, array_to_string(list_filter(['TIN', 'BRASS', 'GOLD', 'STEEL'], lambda m: list_contains(list_transform(a, lambda x: upper(x)), m)), ',') AS models FROM h",
)


# What a prompt says of the language, first match first.
PROMPT_HINTS = [
    ("anglo norman", "anglo_norman"), ("old french", "old_french"), ("middle french", "middle_french"), ("medieval french", "middle_french"), ("latin", "latin"), ("french", "french"),
    ("occitan|old occitan|provencal", "occitan"), ("italian", "italian"), ("spanish|iberian|portuguese|catalan", "spanish"), ("middle english", "middle_english"), ("old english", "old_english"),
    ("middle high german", "middle_high_german"), ("old high german", "old_high_german"), ("german|dutch|flemish", "german"),
]
PROMPTS = ["Read this OLD French page", "medieval latin?", "French or German", "it is prov4ncal", "middle  high german!", "Old-English hand", "all embelished initials", "Which regions show music lines", "the main script coloured", "page number 4", "no hint"]
command = lambda c: F.regexp_replace(F.regexp_replace(F.replace(F.lower(T.strip(c)), F.lit("4"), F.lit("a")), r"[^a-z0-9\s]", " "), r"\s+", " ")
Q_COMMAND = r"regexp_replace(regexp_replace(replace(lower(trim(p)), '4', 'a'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')"
asked = lambda: F.concat_ws(" ", sample(PROMPTS, F.col("conv_id") + F.col("turn")), F.when(F.col("turn") % 3 == 0, F.col("text")))
Q_ASKED = f"c AS (SELECT conv_id, turn, concat_ws(' ', {q_sample(PROMPTS, '(conv_id + turn)')}, CASE WHEN turn % 3 = 0 THEN text END) AS p FROM conversations), v AS (SELECT conv_id, turn, {Q_COMMAND} AS v FROM c)"


def prompt_hints(s, d):
    """Language, script and backend that a prompt names; nulls where it names none."""
    v, language = F.col("v"), None
    for words, name in PROMPT_HINTS:
        hit = v.rlike(f"\\b(?:{words})\\b")
        language = F.when(hit, name) if language is None else language.when(hit, name)
    rows = read(s, d, "conversations").select("conv_id", "turn", command(asked()).alias("v")).select("conv_id", "turn", language.alias("language"))
    known = F.col("language").isNotNull()
    return rows.select("conv_id", "turn", "language", F.when(F.col("language") == "old_english", "insular_old_english").when(known, "latin").alias("script"), F.when(known, "auto").alias("backend"))


register(
    "C9_prompt_hints",
    prompt_hints,
    f"WITH {Q_ASKED}, l AS (SELECT conv_id, turn, CASE {' '.join(f'WHEN regexp_matches(v, {chr(39)}{chr(92)}b(?:{w}){chr(92)}b{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for w, n in PROMPT_HINTS)} END AS language FROM v) SELECT conv_id, turn, language, CASE WHEN language = 'old_english' THEN 'insular_old_english' WHEN language IS NOT NULL THEN 'latin' END AS script, CASE WHEN language IS NOT NULL THEN 'auto' END AS backend FROM l",
)
labelled = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(command(c), r"\bembelished\b", "embellished"), r"\blabels\b", "label"), r"\bregions\b", "region")
q_labelled = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '\bembelished\b', 'embellished', 'g'), '\blabels\b', 'label', 'g'), '\bregions\b', 'region', 'g')"


def label_name(label: str) -> str:
    """What :func:`labelled` makes of a label (of ASCII)."""
    name = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", label.strip().lower().replace("4", "a")))
    for old, new in (("embelished", "embellished"), ("labels", "label"), ("regions", "region")):
        name = re.sub(rf"\b{old}\b", new, name)
    return name


def best_labels(s, d):
    """For every prompt the label with most points, the first of equals: 100 if it is named whole, 10 for each word of it, more for initials."""
    rows = spread(read(s, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", labelled(asked()).alias("prompt"))
    prompt = F.col("prompt")

    def points(i: int, name: str) -> Column:
        one = lambda hit, n: F.when(hit, n).otherwise(0)
        n = one(prompt.contains(name), 100)
        for word, worth in [*((w, 10) for w in name.split(" ") if len(w) >= 3), *((w, k) for w, k in (("embellished", 50), ("initial", 30)) if w in name)]:
            n = n + one(prompt.contains(word), worth)
        return F.struct(n.alias("n"), F.lit(-i).alias("i"))

    # The names of the labels are told once, not for every prompt.
    best = F.array_max(F.array(*[points(i, label_name(x)) for i, x in enumerate(LABELS)]))
    rows = rows.select("conv_id", "turn", best.alias("best")).where("best.n > 0")
    return rows.select("conv_id", "turn", F.element_at(lit(LABELS), 1 - F.col("best.i")).alias("label"), F.col("best.n").alias("points"))


register(
    "C10_best_label",
    best_labels,
    f"WITH {Q_ASKED}, q AS (SELECT conv_id, turn, {q_labelled('v')} AS prompt FROM v), l AS (SELECT label, i, {q_labelled(Q_COMMAND)} AS name FROM (SELECT label, label AS p, i FROM (SELECT unnest({Q.array(LABELS)}) AS label, unnest(range({len(LABELS)})) AS i))), "
    "sc AS (SELECT conv_id, turn, label, i, (CASE WHEN contains(prompt, name) THEN 100 ELSE 0 END + 10 * len(list_filter(string_split(name, ' '), lambda w: length(w) >= 3 AND contains(prompt, w))) + CASE WHEN contains(prompt, 'embellished') AND contains(name, 'embellished') THEN 50 ELSE 0 END + CASE WHEN contains(prompt, 'initial') AND contains(name, 'initial') THEN 30 ELSE 0 END)::INT AS points FROM q, l) "
    "SELECT conv_id, turn, label, points FROM sc WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY points DESC, i) = 1",
)

# ---- names and places (P16, P18, T30) ----------------------------------------------------------------


def names_of(token: Column) -> tuple[Column, Column]:
    """Least normalised distance of a token to the known names, and whether one is near enough and shares its bigrams."""
    known = lit(NAMES)
    least = F.array_min(F.transform(known, lambda n: T.normalized_edit_distance(token, n)))
    near = F.exists(known, lambda n: (T.normalized_edit_distance(token, n) <= 0.25) & (T.bigram_overlap(token, n) >= 0.40))
    return least, near


def medieval_name(token: Column) -> Column:
    """A known name, or a token of 3 to 18 letters with fair vowels, no four consonants, and not far from a known name if it is longer."""
    least, near = names_of(token)
    n, v = F.length(token), T.vowel_share_of_length(token)
    fair = v.between(0.20, 0.80) & ~token.rlike(f"[^{C.VOWELS}]{{4,}}") & ((n < 5) | (least <= 0.35))
    return n.between(3, 18) & ~token.isin(*C.COMMON_WORDS) & (F.when(n < 5, least == 0.0).otherwise(near) | fair)


def letter_tokens(s, d):
    worn_names = F.concat(F.lower(plain(F.col("text"))), F.lit(" "), sample(["artur", "lancelott", "guenivre", "percevol", "bors", "merlyn", "trystan"], F.col("doc_id")))
    return documents(s, d).select(F.explode(F.regexp_extract_all(worn_names, F.lit("([a-z]+)"), F.lit(1))).alias("token")).distinct()


LETTER_TOKENS = f"{DOCS}, tok AS (SELECT DISTINCT unnest(regexp_extract_all(concat(lower({q_plain('text')}), ' ', {q_sample(['artur', 'lancelott', 'guenivre', 'percevol', 'bors', 'merlyn', 'trystan'], 'doc_id')}), '[a-z]+')) AS token FROM docs), known AS (SELECT unnest({Q.array(NAMES)}) AS name)"
NEAR = f"near AS (SELECT token, min({Q.edit_distance('token', 'name')}) AS least, bool_or({Q.edit_distance('token', 'name')} <= 0.25e0 AND {Q.dice(Q.bigrams('token'), Q.bigrams('name'))} >= 0.4e0) AS near FROM tok, known GROUP BY 1)"
Q_V = Q.vowel_share_of_length("token")
register(
    "P16_medieval_name",
    lambda s, d: letter_tokens(s, d).select("token", medieval_name(F.col("token")).alias("name_like")),
    f"WITH {LETTER_TOKENS}, {NEAR} SELECT token, length(token) BETWEEN 3 AND 18 AND token NOT IN {Q.words(C.COMMON_WORDS)} AND (CASE WHEN length(token) < 5 THEN least = 0 ELSE near END OR ({Q_V} BETWEEN 0.2e0 AND 0.8e0 AND NOT regexp_matches(token, '[^{C.VOWELS}]{{4,}}') AND (length(token) < 5 OR least <= 0.35e0))) AS name_like FROM near",
)


def name_score(t: Column) -> Column:
    v, n = T.vowel_share_of_length(t), F.length(t)
    run = F.when(t.rlike(f"[^{C.VOWELS}]{{4,}}"), 0.35).otherwise(0.0)
    return F.lit(0.5) - F.when((n < 3) | (n > 20), 0.30).otherwise(0.0) + F.when((v < 0.15) | (v > 0.85), -0.30).when(v.between(0.25, 0.65), 0.15).otherwise(0.0) - run


def name_likeness(surfaces: DataFrame) -> DataFrame:
    """(surface, score): 1 for a known name, 0.9 for one near it, 0.05 without content words, else the mean over these, 0.1 more for two good ones."""
    rows = surfaces.select("surface", F.explode(F.filter(F.split(F.lower(F.regexp_replace("surface", r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), lambda w: w != "")).alias("t"))
    t = F.col("t")
    _, near = names_of(t)
    common = t.isin(*C.COMMON_WORDS)
    content = ~common & (F.length(t) >= 2)
    rows = rows.select("surface", (~common & t.isin(*NAMES)).alias("known"), (~common & (F.length(t) >= 5) & near).alias("near"), F.when(content, name_score(t)).alias("score"))
    good = F.count(F.when(F.col("score") > 0, 1))
    mean = F.avg(F.greatest(F.lit(0.0), F.col("score")))
    score = F.when(F.bool_or("known"), 1.0).when(F.bool_or("near"), 0.90).when(F.count("score") == 0, 0.05).otherwise(F.round(F.least(F.lit(1.0), F.when(good >= 2, mean + 0.10).otherwise(mean)), 3))
    return rows.groupBy("surface").agg(score.alias("score"))


def surfaces(s, d):
    """Pairs of neighbours of a text's first words, some with a name."""
    w = F.filter(F.split(plain(F.col("text")), r"[^A-Za-z]+"), lambda x: x != "")
    some = documents(s, d).select("doc_id", w.alias("w")).where(F.size("w") >= 2)
    return some.select(F.concat_ws(" ", F.col("w")[0], sample(["", "Artus", "de", "Lancelott", "la"], F.col("doc_id")), F.element_at("w", -1)).alias("surface")).distinct()


Q_SURFACES = f"sw AS (SELECT doc_id, list_filter(string_split_regex({q_plain('text')}, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM docs), sur AS (SELECT DISTINCT concat_ws(' ', w[1], {q_sample(['', 'Artus', 'de', 'Lancelott', 'la'], 'doc_id')}, w[-1]) AS surface FROM sw WHERE len(w) >= 2)"
Q_NAME_SCORE = f"(0.5e0 - (CASE WHEN length(token) < 3 OR length(token) > 20 THEN 0.3e0 ELSE 0e0 END) + (CASE WHEN {Q_V} < 0.15e0 OR {Q_V} > 0.85e0 THEN -0.3e0 WHEN {Q_V} BETWEEN 0.25e0 AND 0.65e0 THEN 0.15e0 ELSE 0e0 END) - (CASE WHEN regexp_matches(token, '[^{C.VOWELS}]{{4,}}') THEN 0.35e0 ELSE 0e0 END))"
register(
    "T30_name_likeness",
    lambda s, d: name_likeness(surfaces(s, d)),
    f"WITH {DOCS}, {Q_SURFACES}, tk AS (SELECT surface, unnest(list_filter(string_split_regex(lower(surface), ' +'), lambda x: x <> '')) AS token FROM sur), tok AS (SELECT DISTINCT token FROM tk), known AS (SELECT unnest({Q.array(NAMES)}) AS name), {NEAR}, "
    f"f AS (SELECT surface, token NOT IN {Q.words(C.COMMON_WORDS)} AND token IN {Q.words(NAMES)} AS known, token NOT IN {Q.words(C.COMMON_WORDS)} AND length(token) >= 5 AND near AS near, CASE WHEN token NOT IN {Q.words(C.COMMON_WORDS)} AND length(token) >= 2 THEN {Q_NAME_SCORE} END AS score FROM tk JOIN near USING (token)) "
    "SELECT surface, CASE WHEN bool_or(known) THEN 1e0 WHEN bool_or(near) THEN 0.9e0 WHEN count(score) = 0 THEN 0.05e0 ELSE round(least(1e0, avg(greatest(0e0, score)) + CASE WHEN count(*) FILTER (score > 0) >= 2 THEN 0.1e0 ELSE 0e0 END), 3) END AS score FROM f GROUP BY 1",
)


def place_context(surface: Column, evidence: Column) -> Column:
    """One of fifteen phrases before the surface, a locative up to three words before it, or a head word and `de` before it."""
    padded = F.concat(F.lit(" "), evidence, F.lit(" "))
    phrase = None
    for p in PLACE_PATTERNS:
        hit = F.contains(padded, F.concat(F.lit(f" {p} "), surface, F.lit(" ")))
        phrase = hit if phrase is None else phrase | hit
    near = F.regexp_like(padded, F.concat(F.lit(f"\\b(?:{'|'.join(LOCATIVES)})\\b(?:\\s+\\w+){{0,3}}\\s+"), surface, F.lit("\\b")))
    head = F.regexp_like(padded, F.concat(F.lit(f"\\b(?:{'|'.join(HEADWORDS)})\\b(?:\\s+\\w+){{0,2}}\\s+(?:de|del|du|des)\\s+"), surface, F.lit("\\b")))
    return phrase | near | head


EVIDENCE_INSERT = ["", " en ", " a la ", " ville x de ", " vers y z "]
searchable = lambda c: T.collapse(F.regexp_replace(F.lower(plain(c)), "[^a-z0-9 ]", " "))
q_searchable = lambda x: f"regexp_replace(trim(regexp_replace(lower({q_plain(x)}), '[^a-z0-9 ]', ' ', 'g')), ' +', ' ', 'g')"


def place_rows(s, d):
    """Each text's longest token as a surface, its text with a phrase before that token as evidence."""
    base = documents(s, d).select("doc_id", searchable(F.col("text")).alias("e")).where("e <> ''")
    longest = F.array_max(F.transform(F.split("e", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    base = base.withColumn("surface", longest)
    return base.select("doc_id", "surface", F.concat("e", sample(EVIDENCE_INSERT, F.col("doc_id")), F.lit(" "), F.col("surface")).alias("evidence")).select("doc_id", "surface", T.collapse("evidence").alias("evidence"))


register(
    "P18_place_context",
    lambda s, d: place_rows(s, d).select("doc_id", "surface", place_context(F.col("surface"), F.col("evidence")).alias("place")),
    f"WITH {DOCS}, e AS (SELECT doc_id, {q_searchable('text')} AS e FROM docs), w AS (SELECT doc_id, e, list_max(list_transform(string_split(e, ' '), lambda w: {{'n': length(w), 'w': w}})).w AS surface FROM e WHERE e <> ''), p AS (SELECT doc_id, surface, ' ' || regexp_replace(trim(concat(e, {q_sample(EVIDENCE_INSERT, 'doc_id')}, ' ', surface)), ' +', ' ', 'g') || ' ' AS padded FROM w) "
    f"SELECT doc_id, surface, {' OR '.join(f'contains(padded, concat({chr(39)} {p} {chr(39)}, surface, {chr(39)} {chr(39)}))' for p in PLACE_PATTERNS)} OR regexp_matches(padded, '\\b(?:{'|'.join(LOCATIVES)})\\b(?:\\s+\\w+){{0,3}}\\s+' || surface || '\\b') OR regexp_matches(padded, '\\b(?:{'|'.join(HEADWORDS)})\\b(?:\\s+\\w+){{0,2}}\\s+(?:de|del|du|des)\\s+' || surface || '\\b') AS place FROM p",
)

# ---- mentions in their text (T87, T88) ---------------------------------------------------------------


def window(radius: int) -> Column:
    """The text around a mention, as far as it goes."""
    return F.expr(f"substring(text, greatest(0, start_offset - {radius}) + 1, end_offset + {radius} - greatest(0, start_offset - {radius}))")


q_window = lambda radius: f"substr(text, greatest(0, start_offset - {radius}) + 1, end_offset + {radius} - greatest(0, start_offset - {radius}))"


def mentions_in_text(s, d) -> DataFrame:
    """High-recall mentions with their text and the line that they begin in."""
    lines = X.line_chunks(documents(s, d)).select(F.col("doc_id").alias("chunk_doc"), F.col("start_offset").alias("from_"), F.col("end_offset").alias("to_"), F.col("text").alias("chunk"))
    found = X.high_recall_mentions(documents(s, d)).join(documents(s, d).select("doc_id", "text"), "doc_id")
    return found.join(lines, (F.col("doc_id") == F.col("chunk_doc")) & F.col("start_offset").between(F.col("from_"), F.col("to_") - 1), "left")


register("T87_context_window", lambda s, d: X.high_recall_mentions(documents(s, d)).join(documents(s, d).select("doc_id", "text"), "doc_id").select("doc_id", "start_offset", "end_offset", "method", window(40).alias("context")), f"WITH {DOCS}, {RECALL} SELECT recall.doc_id, start_offset, end_offset, method, {q_window(40)} AS context FROM recall JOIN docs USING (doc_id)")
Q_CHUNK_LINES = "p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), q AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM p), r AS (SELECT doc_id, line, pos, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS e FROM q)"
register(
    "T88_context",
    lambda s, d: mentions_in_text(s, d).select("doc_id", "start_offset", "end_offset", "method", F.sha2(F.concat_ws(" ", F.when(F.col("chunk") != "", F.col("chunk")), window(200)), 256).alias("sha")),
    f"WITH {DOCS}, {RECALL}, {Q_CHUNK_LINES}, kept AS (SELECT doc_id, e - length(line) AS s, e, line FROM r WHERE length({Q.strip('line')}) >= 2 AND lower({Q.strip('line')}) NOT IN {Q.words(C.CHUNK_STOPWORDS)} UNION ALL SELECT doc_id, 0, length(text), text FROM docs WHERE length({Q.strip('text')}) > 0 AND doc_id NOT IN (SELECT doc_id FROM r WHERE length({Q.strip('line')}) >= 2 AND lower({Q.strip('line')}) NOT IN {Q.words(C.CHUNK_STOPWORDS)})) "
    f"SELECT m.doc_id, start_offset, end_offset, method, sha256(concat_ws(' ', nullif(line, ''), {q_window(200)})) AS sha FROM recall m JOIN docs USING (doc_id) LEFT JOIN kept k ON k.doc_id = m.doc_id AND start_offset BETWEEN k.s AND k.e - 1",
)

# ---- salvaged mentions (M3) ---------------------------------------------------------------------------

SALVAGE_INSERTS = [" le roi Artus vint ", " saint graal de Paris ", " la dame de bien ", " en enfant, du Chastelx au ", " del reaume d' Avignon ", " Lancelott duc xqzt. ", " l'an de grace mil cinq cens¶", " en 1234, MCCXL: lan¶mil deux mars "]
FIRST_LINES = ["", "Le livre du roi¶", "", "La¶", "l'estoire de Merlin ¶"]


def old_texts(s, d) -> DataFrame:
    """Texts in plain letters with a first line and a phrase of the kind that the rules look for."""
    broken = lambda values: F.replace(sample(values, F.col("doc_id")), F.lit("¶"), F.lit("\n"))
    return spread(documents(s, d).select("doc_id", "text")).select("doc_id", F.concat(broken(FIRST_LINES), plain(F.col("text")), broken(SALVAGE_INSERTS)).alias("text"))


OLD_TEXTS = f"{DOCS}, old AS (SELECT doc_id, concat(replace({q_sample(FIRST_LINES, 'doc_id')}, '¶', chr(10)), {q_plain('text')}, replace({q_sample(SALVAGE_INSERTS, 'doc_id')}, '¶', chr(10))) AS text FROM docs)"
_lead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY doc_id ORDER BY pos) AS {c}{k}"
_fit = lambda k: f"coalesce(length(gap{k}) <= 3 AND NOT regexp_matches(gap{k}, '[.;:!?]') AND length(surface{k}) >= 2 AND lower(surface{k}) NOT IN {Q.words(X.SALVAGE_STOPWORDS + X.SALVAGE_TRIGGERS)}, false)"
_like = lambda k: f"(size >= {k} AND lower(surface{k}) NOT IN {Q.words(C.COMMON_WORDS)} AND lower(surface{k}) IN (SELECT token FROM likely))"
SALVAGED = (
    f"{OLD_TEXTS}, st AS ({q_matches('old', 'text', X.SALVAGE_TOKEN)}), ah AS (SELECT *, {', '.join(_lead(c, k) for k in range(1, 5) for c in ('surface', 'gap', 'end_offset'))} FROM st), tg AS (SELECT *, {', '.join(f'{_fit(k)} AS f{k}' for k in range(1, 5))} FROM ah WHERE lower(surface) IN {Q.words(X.SALVAGE_TRIGGERS)}), "
    "sz AS (SELECT *, CASE WHEN NOT f1 THEN 0 WHEN NOT f2 THEN 1 WHEN NOT f3 THEN 2 WHEN NOT f4 THEN 3 ELSE 4 END AS size FROM tg), tok AS (SELECT DISTINCT unnest([lower(surface1), lower(surface2), lower(surface3), lower(surface4)][1:size]) AS token FROM sz), "
    f"known AS (SELECT unnest({Q.array(NAMES)}) AS name), {NEAR}, likely AS (SELECT token FROM near WHERE length(token) BETWEEN 3 AND 18 AND token NOT IN {Q.words(C.COMMON_WORDS)} AND (CASE WHEN length(token) < 5 THEN least = 0 ELSE near END OR ({Q_V} BETWEEN 0.2e0 AND 0.8e0 AND NOT regexp_matches(token, '[^{C.VOWELS}]{{4,}}') AND (length(token) < 5 OR least <= 0.35e0)))), "
    f"nm AS (SELECT *, {' OR '.join(_like(k) for k in range(1, 5))} AS likes, {' OR '.join(f'(size >= {k} AND lower(surface{k}) NOT IN {Q.words(C.COMMON_WORDS)})' for k in range(1, 5))} AS content FROM sz WHERE size > 0), "
    "names AS (SELECT doc_id, start_offset, CASE size WHEN 1 THEN end_offset1 WHEN 2 THEN end_offset2 WHEN 3 THEN end_offset3 ELSE end_offset4 END AS end_offset, surface || gap1 || surface1 || CASE WHEN size >= 2 THEN gap2 || surface2 ELSE '' END || CASE WHEN size >= 3 THEN gap3 || surface3 ELSE '' END || CASE WHEN size >= 4 THEN gap4 || surface4 ELSE '' END AS surface, "
    "CASE WHEN likes THEN 'person' ELSE 'role' END AS ent_type, CASE WHEN likes THEN 0.55e0 ELSE 0.25e0 END AS confidence, 'rule:salvage_trigger' AS method FROM nm WHERE content), "
    f"wk AS (SELECT DISTINCT lower(surface) AS low FROM st WHERE length(surface) >= 4 AND lower(surface) NOT IN {Q.words(C.COMMON_WORDS)}), wc AS (SELECT low, {Q.edit_distance('low', 'work')} AS nd, i FROM wk, (SELECT unnest({Q.array(X.SALVAGE_WORKS)}) AS work, unnest(range({len(X.SALVAGE_WORKS)})) AS i) "
    f"WHERE CASE WHEN length(low) < 5 THEN low = work ELSE {Q.edit_distance('low', 'work')} <= 0.25e0 AND {Q.dice(Q.bigrams('low'), Q.bigrams('work'))} >= 0.4e0 END QUALIFY row_number() OVER (PARTITION BY low ORDER BY i) = 1), "
    "works AS (SELECT doc_id, start_offset, end_offset, surface, 'work' AS ent_type, greatest(0.35e0, 0.65e0 - nd) AS confidence, 'rule:salvage_work_fuzzy' AS method FROM st JOIN wc ON low = lower(surface)), "
    f"ph AS ({q_matches('old', 'text', '(?i)' + chr(92) + 'b' + X.PLACE_PREPOSITION.replace(chr(39), chr(39) * 2))}), pn AS (SELECT DISTINCT st.doc_id, st.start_offset, st.end_offset, st.surface FROM ph JOIN st ON st.doc_id = ph.doc_id AND st.start_offset BETWEEN ph.end_offset AND ph.end_offset + 2 QUALIFY row_number() OVER (PARTITION BY ph.doc_id, ph.end_offset ORDER BY st.start_offset) = 1), "
    f"pq AS (SELECT *, lower(surface) AS low, {Q.token_quality('lower(surface)')} AS q, lower(surface) IN {Q.words(C.PLACE_ANCHORS)} AS anchor, regexp_matches(surface, '^\\p{{Lu}}') AS capital FROM pn), "
    f"pr AS (SELECT *, CASE WHEN low IN {Q.words(X.EDITORIAL)} THEN 'editorial_blacklist' WHEN low IN {Q.words(X.WEAK_PLACES)} THEN 'weak_place_lexical_blacklist' WHEN length(surface) < 5 OR low IN {Q.words(X.SALVAGE_STOPWORDS)} THEN 'too_short_or_stopword' WHEN NOT anchor AND NOT capital AND (length(surface) < 6 OR q < 0.5e0) THEN 'place_likeness' WHEN NOT anchor AND capital AND q < 0.4e0 THEN 'place_likeness' END AS reason FROM pq)"
)
register(
    "M3_salvaged_mentions",
    lambda s, d: N.salvaged_mentions(old_texts(s, d), tuple(NAMES)),
    f"WITH {SALVAGED} SELECT * FROM names UNION ALL SELECT * FROM works UNION ALL SELECT doc_id, start_offset, end_offset, surface, 'place', 0.35e0, 'rule:salvage_place_candidate' FROM pr WHERE reason IS NULL AND (doc_id, start_offset, end_offset) NOT IN (SELECT (doc_id, start_offset, end_offset) FROM works)",
)
register("M3_rejected_places", lambda s, d: K.by_text(old_texts(s, d), "start_offset int, surface string, reason string", N.rejected_places, "text", many=True), f"WITH {SALVAGED} SELECT doc_id, start_offset, surface, reason FROM pr WHERE reason IS NOT NULL")

# ---- anchors and all mentions without overlaps (M2, W5, X6) ----------------------------------------------

_quoted = lambda x: x.replace("'", "''")
_edged = lambda p: _quoted("(?i)\\b" + p.replace(X.EDGE[1], "\\b"))
_sql_pattern = lambda p: _quoted(p.replace(X.EDGE[0], "\\b").replace(X.EDGE[1], "\\b"))


def q_dated(x: str) -> str:
    words = f"regexp_extract_all(lower({x}), '{_quoted(chr(91))}A-Za-zÀ-ÿ''’]+')"
    return f"(regexp_matches({x}, '{_sql_pattern(X.DATE_FORMULA)}') OR regexp_matches({x}, '{_sql_pattern(X.NUMBER)}') OR regexp_matches({x}, '{_sql_pattern(X.ROMAN_YEAR)}') OR list_has_any({words}, {Q.array([*C.DATE_ANCHORS, *C.MONTHS])}))"


ANCHORS = (
    f"an AS (SELECT doc_id, start_offset, end_offset, surface, CASE WHEN lower(surface) IN {Q.words(C.PLACE_ANCHORS)} THEN 'place' ELSE 'title' END AS ent_type, CASE WHEN lower(surface) IN {Q.words(C.PLACE_ANCHORS)} THEN 0.84e0 ELSE 0.64e0 END AS confidence, CASE WHEN lower(surface) IN {Q.words(C.PLACE_ANCHORS)} THEN 'rule:toponym_anchor' ELSE 'rule:title_anchor' END AS method "
    f"FROM ({q_matches('old', 'text', chr(91) + 'A-Za-z0-9_]+')}) WHERE lower(surface) IN {Q.words(C.PLACE_ANCHORS + C.TITLE_ANCHORS)}), "
    f"da AS ({' UNION ALL '.join('(' + q_matches('old', 'text', _edged(p)) + ')' for p in X.DATE_PATTERNS)}), dd AS (SELECT *, string_split(surface, chr(10)) AS ls FROM da), "
    f"dates AS (SELECT doc_id, start_offset, end_offset, surface, 'date' AS ent_type, 0.72e0 AS confidence, 'rule:date_pattern' AS method FROM dd WHERE {q_dated('surface')} AND (len(ls) = 1 OR regexp_matches(surface, '{_sql_pattern(X.DATE_FORMULA)}') OR ({q_dated('ls[1]')} AND {q_dated('ls[-1]')}))), "
    f"fl AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.strip('x')}), lambda x: x <> '')[1] AS first FROM old), first AS (SELECT doc_id, (instr(text, first) - 1)::INT AS start_offset, (instr(text, first) - 1 + length(first))::INT AS end_offset, first AS surface, 'work' AS ent_type, 0.56e0 AS confidence, 'rule:first_line_title_heuristic' AS method "
    f"FROM fl WHERE length(first) <= 80 AND regexp_matches(lower(first), '^(la |le |l''|l’)') AND len({Q.tokens('first')}) >= 2), anchored AS (SELECT * FROM an UNION ALL SELECT * FROM dates UNION ALL SELECT * FROM first)"
)
register("M2_anchor_mentions", lambda s, d: X.anchor_mentions(old_texts(s, d)), f"WITH {OLD_TEXTS}, {ANCHORS} SELECT * FROM anchored")


_over_old = lambda sql: sql.replace("FROM docs)", "FROM old)").replace("JOIN docs ON docs.doc_id", "JOIN old ON old.doc_id")
ALL_MENTIONS = (
    f"{SALVAGED}, {ANCHORS}, pe AS (WITH {_over_old(SIGNS)} SELECT * FROM person), hr AS (WITH {_over_old(RECALL)} SELECT * FROM recall), salvage AS (SELECT * FROM names UNION ALL SELECT * FROM works UNION ALL SELECT doc_id, start_offset, end_offset, surface, 'place', 0.35e0, 'rule:salvage_place_candidate' FROM pr WHERE reason IS NULL AND (doc_id, start_offset, end_offset) NOT IN (SELECT (doc_id, start_offset, end_offset) FROM works)), "
    "every AS (SELECT doc_id, start_offset, end_offset, surface, ent_type, confidence, method FROM pe UNION ALL SELECT * FROM anchored UNION ALL SELECT * FROM salvage UNION ALL SELECT * FROM hr), best AS (SELECT doc_id, ent_type, start_offset, end_offset, max(confidence) AS confidence, max_by(surface, (confidence, method)) AS surface, max_by(method, (confidence, method)) AS method FROM every WHERE end_offset > start_offset GROUP BY 1, 2, 3, 4), "
    "li AS (SELECT doc_id, ent_type, list([[start_offset, end_offset]] ORDER BY confidence DESC, start_offset - end_offset, start_offset, end_offset) AS l FROM best GROUP BY 1, 2), "
    "ke AS (SELECT doc_id, ent_type, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: x[1][1] < k[2] AND x[1][2] > k[1])) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM li), kept AS (SELECT b.* FROM best b JOIN ke ON ke.doc_id = b.doc_id AND ke.ent_type = b.ent_type AND k[1] = start_offset AND k[2] = end_offset)"
)
register("X6_W5_deduplicated_mentions", lambda s, d: N.deduplicated_mentions(old_texts(s, d), tuple(NAMES)), f"WITH {ALL_MENTIONS} SELECT doc_id, start_offset, end_offset, surface, ent_type, confidence, method FROM kept")
