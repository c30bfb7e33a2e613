"""Chunks and mentions of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import constants as C
from palimpsest.operators import extraction as X
from palimpsest.plans import sql as Q
from palimpsest.plans.text_quality import DOCS, documents
from palimpsest.registry import register

PARTS = f"{DOCS}, p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs), q AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM p), r AS (SELECT doc_id, line, pos, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS e FROM q)"
CHUNKS = f"{PARTS}, kept AS (SELECT doc_id, pos, e - length(line) AS s, e, line FROM r WHERE length({Q.strip('line')}) >= 2 AND lower({Q.strip('line')}) NOT IN {Q.words(C.CHUNK_STOPWORDS)}), chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS idx, s::INT AS start_offset, e AS end_offset, line AS text FROM kept UNION ALL SELECT doc_id, 0, 0, length(text)::INT, text FROM docs WHERE length({Q.strip('text')}) > 0 AND doc_id NOT IN (SELECT doc_id FROM kept))"
register("N13_line_chunks", lambda s, d: X.line_chunks(documents(s, d)), f"WITH {CHUNKS} SELECT * FROM chunks")
register("V5_index_chunks", lambda s, d: X.line_chunks(documents(s, d)).where(F.length("text") >= 40).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_offset").alias("reach")), f"WITH {CHUNKS} SELECT doc_id, count(*) AS chunks, max(end_offset) AS reach FROM chunks WHERE length(text) >= 40 GROUP BY 1")

def q_matches(source: str, text: str, pattern: str) -> str:
    """The matches of a pattern with the text before each and their code-point offsets."""
    return (
        f"SELECT doc_id, pos, gap, surface, (e - length(surface))::INT AS start_offset, e::INT AS end_offset FROM (SELECT *, sum(length(gap) + length(surface)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM "
        f"(SELECT doc_id, unnest(range(len(m))) AS pos, unnest(gaps[1:len(m)]) AS gap, unnest(m) AS surface FROM (SELECT doc_id, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS m FROM {source})))"
    )


quoted = lambda x: x.replace("'", "''")
SIGNS = (
    f"tok AS ({q_matches('docs', 'text', quoted(X.TOKEN))}), kinds AS (SELECT *, regexp_matches(surface, '^\\p{{Lu}}') AND NOT regexp_matches(surface, '{X.ROMAN}') AS name, lower(surface) IN {Q.words(X.PARTICLES)} AS particle FROM tok), "
    f"signs AS (SELECT doc_id, string_agg(concat(CASE WHEN regexp_matches(gap, '{X.JOINED}') THEN '-' ELSE '|' END, CASE WHEN name AND particle THEN 'B' WHEN name THEN 'N' WHEN particle THEN 'P' ELSE 'x' END), '' ORDER BY pos) AS signs FROM kinds GROUP BY 1), "
    f"runs AS ({q_matches('signs', 'signs', X.sequence_pattern())}), "
    "named AS (SELECT r.doc_id, (r.start_offset - 1) // 2 AS first, (r.end_offset - 2) // 2 AS last, length(regexp_replace(r.surface, '[^N]', '', 'g')) + starts_with(r.surface, 'B')::INT AS n, regexp_matches(substr(signs, r.start_offset + 2, 12), '^(-N)*-[PB]') AS linked FROM runs r JOIN signs USING (doc_id)), "
    "person AS (SELECT n.doc_id, a.start_offset, z.end_offset, substr(text, a.start_offset + 1, z.end_offset - a.start_offset) AS surface, 'person' AS ent_type, round(CASE WHEN linked THEN least(0.85e0, 0.65e0 + least(0.15e0, 0.05e0 * (n - 2)) + 0.05e0) ELSE 0.65e0 + least(0.15e0, 0.05e0 * (n - 2)) END, 4) AS confidence, 'rule:proper_name_sequence' AS method "
    "FROM named n JOIN tok a ON a.doc_id = n.doc_id AND a.pos = n.first JOIN tok z ON z.doc_id = n.doc_id AND z.pos = n.last JOIN docs ON docs.doc_id = n.doc_id)"
)
WORD_ANCHORS = (
    f"word AS ({q_matches('docs', 'text', chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+')}), anchors AS (SELECT doc_id, start_offset, end_offset, surface, CASE WHEN place THEN 'place' ELSE 'title' END AS ent_type, CASE WHEN place THEN 0.84e0 ELSE 0.64e0 END AS confidence, CASE WHEN place THEN 'rule:toponym_anchor' ELSE 'rule:title_anchor' END AS method "
    f"FROM (SELECT *, lower(surface) IN {Q.words(C.PLACE_ANCHORS)} AS place FROM word) WHERE place OR lower(surface) IN {Q.words(C.TITLE_ANCHORS)})"
)
AHEAD = "OVER (PARTITION BY doc_id ORDER BY pos)"
RECALL = (
    f"tok AS ({q_matches('docs', 'text', X.RECALL_TOKEN)}), ahead AS (SELECT *, lead(surface) {AHEAD} AS nxt, lead(start_offset) {AHEAD} AS nxt_s, lead(end_offset) {AHEAD} AS nxt_e, lead(gap) {AHEAD} AS nxt_g, lead(surface, 2) {AHEAD} AS third, lead(gap, 2) {AHEAD} AS third_g, lead(end_offset, 2) {AHEAD} AS third_e FROM tok), "
    f"trig AS (SELECT *, CASE WHEN lower(surface) IN {Q.words(X.TRIGGERS['person'])} THEN 'person' WHEN lower(surface) IN {Q.words(X.TRIGGERS['place'])} THEN 'place' END AS kind, coalesce((lower(third) IN {Q.words(X.PREFIXES)} OR length(third) >= 4) AND length(third_g) <= 2, false) AS more FROM ahead), "
    "recall AS (SELECT doc_id, nxt_s AS start_offset, CASE WHEN more THEN third_e ELSE nxt_e END AS end_offset, CASE WHEN more THEN nxt || third_g || third ELSE nxt END AS surface, kind AS ent_type, 0.35e0 AS confidence, 'high_recall:trigger' AS method FROM trig WHERE kind IS NOT NULL AND length(nxt) >= 3 "
    "UNION ALL SELECT doc_id, start_offset, end_offset, surface, 'person', 0.25e0, 'high_recall:capitalized' FROM trig WHERE length(surface) >= 5 AND regexp_matches(surface, '^\\p{Lu}') "
    f"UNION ALL SELECT doc_id, start_offset, nxt_e, surface || nxt_g || nxt, 'person', 0.3e0, 'high_recall:name_prefix' FROM trig WHERE lower(surface) IN {Q.words(X.PREFIXES)} AND length(nxt) >= 4)"
)
register("M1_person_mentions", lambda s, d: X.person_mentions(documents(s, d)), f"WITH {DOCS}, {SIGNS} SELECT * FROM person")
register("M2_word_anchors", lambda s, d: X.word_anchors(documents(s, d)), f"WITH {DOCS}, {WORD_ANCHORS} SELECT * FROM anchors")
register("M4_high_recall_mentions", lambda s, d: X.high_recall_mentions(documents(s, d)), f"WITH {DOCS}, {RECALL} SELECT * FROM recall")
register("T77_decorated_initial", lambda s, d: documents(s, d).select("doc_id", F.split("text", "\n").alias("ls")).select("doc_id", F.when((F.size("ls") >= 2) & (F.length(F.col("ls")[0]) == 1), F.concat(F.col("ls")[0], F.col("ls")[1])).otherwise(F.col("ls")[0]).alias("first_line")), f"WITH {DOCS}, l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs) SELECT doc_id, CASE WHEN len(ls) >= 2 AND length(ls[1]) = 1 THEN concat(ls[1], ls[2]) ELSE ls[1] END AS first_line FROM l")
register("X8_changed_lines", lambda s, d: documents(s, d).select("doc_id", F.split("text", "\n").alias("a"), F.split(F.regexp_replace("text", "[#*$%&]+", ""), "\n").alias("b")).select("doc_id", F.slice(F.filter(F.transform(F.arrays_zip("a", "b"), lambda p, i: F.when(p["a"] != p["b"], F.concat(F.lit("line_"), (i + 1).cast("string")))), lambda x: x.isNotNull()), 1, 50).alias("changed")).select("doc_id", F.array_join("changed", ",").alias("changed")), f"WITH {DOCS}, l AS (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(regexp_replace(text, '[#*$%&]+', '', 'g'), chr(10)) AS b FROM docs) SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])[1:50], lambda i: concat('line_', i)), ',') AS changed FROM l")
