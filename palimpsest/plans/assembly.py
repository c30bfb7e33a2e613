"""Sinks read back, reports, evidence for a chat, claims, curated mentions and salvaged replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import extraction as X
from palimpsest.operators import store as S
from palimpsest.operators.retrieval import search
from palimpsest.plans import sql as Q
from palimpsest.plans.extraction import CHUNKS
from palimpsest.plans.geometry import B_SQL, boxes
from palimpsest.plans.retrieval import vectors
from palimpsest.plans.store import C_SQL, D_SQL, E_SQL, M_SQL, candidates, decisions, events, mentions, read
from palimpsest.plans.text_quality import DOCS, REPORT_SQL, documents, quality_report
from palimpsest.plans.whole import q_top
from palimpsest.registry import register

lit = lambda values: F.array(*[F.lit(v) for v in values])

# ---- sinks: two batches appended, the table read back (S25, S29-S34, S43) ----------------------


def sink(name: str, rows, sql: str, kind: str, as_json: bool = False, once: bool = False) -> None:
    """``once``: rows that cost more to make than to write are made once, and both batches are read from a table of them."""

    def query(s, d) -> DataFrame:
        table = S.appended([rows(s, d)], f"{kind}-made") if once else rows(s, d)
        first = F.pmod(F.xxhash64(*table.columns), F.lit(2)) == 0
        return S.appended([table.where(first), table.where(~first)], kind, as_json)

    register(name, query, sql)


sink("S25_insert_chunks", lambda s, d: X.line_chunks(documents(s, d)).select(F.sha2(F.concat_ws("|", "doc_id", "idx"), 256).alias("chunk_id"), F.col("doc_id").alias("run_id"), "idx", "start_offset", "end_offset", "text"), f"WITH {CHUNKS} SELECT sha256(concat_ws('|', doc_id, idx)) AS chunk_id, doc_id AS run_id, idx, start_offset, end_offset, text FROM chunks", "chunks")
sink(
    "S29_insert_entity_attempts",
    lambda s, d: candidates(s, d).select("mention_id", (F.row_number().over(Window.partitionBy("mention_id").orderBy("cand_key")) - 1).alias("attempt_idx"), F.col("label").alias("candidate"), "score", F.when(F.col("score") >= 0.85, "ACCEPT").otherwise("REJECT").alias("outcome")),
    f"WITH {C_SQL} SELECT mention_id, (row_number() OVER (PARTITION BY mention_id ORDER BY cand_key) - 1)::INT AS attempt_idx, label AS candidate, score, CASE WHEN score >= 0.85e0 THEN 'ACCEPT' ELSE 'REJECT' END AS outcome FROM candidates",
    "attempts",
)
sink("S30_insert_quality_report", lambda s, d: quality_report(documents(s, d)).select(F.col("doc_id").alias("run_id"), "label", "gibberish", "non_wordlike", "allowed"), f"WITH {REPORT_SQL} SELECT doc_id AS run_id, label, gibberish, non_wordlike, allowed FROM report", "reports", once=True)
sink("S31_insert_tile_audit", lambda s, d: boxes(s, d).select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("box_id")) - 1).alias("tile_idx"), "x1", "y1", "x2", "y2"), f"WITH {B_SQL} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY box_id) - 1)::INT AS tile_idx, x1, y1, x2, y2 FROM boxes", "tiles")
sink("S32_insert_ocr_attempt", lambda s, d: events(s, d).select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "id")) - 1).alias("attempt_idx"), F.col("stage").alias("strategy"), (F.col("event") == "END").alias("gates_passed")), f"WITH {E_SQL} SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY ts, id) - 1)::INT AS attempt_idx, stage AS strategy, event = 'END' AS gates_passed FROM ev", "ocr-attempts")
sink("S33_insert_backend_results", lambda s, d: candidates(s, d).select("run_id", "mention_id", F.col("source").alias("backend_name"), F.col("score").alias("confidence"), (F.col("score") == F.max("score").over(Window.partitionBy("mention_id"))).alias("selected")), f"WITH {C_SQL} SELECT run_id, mention_id, source AS backend_name, score AS confidence, score = max(score) OVER (PARTITION BY mention_id) AS selected FROM candidates", "backend-results")
sink("S34_insert_benchmark_reference", lambda s, d: read(s, d, "benchmark").select(F.sha2(F.concat(F.lit("b|"), F.col("item_id").cast("string")), 256).alias("benchmark_id"), F.col("text").alias("reference_text")), "SELECT sha256(concat('b|', item_id)) AS benchmark_id, text AS reference_text FROM benchmark", "references")
sink("S43_evidence_jsonl", lambda s, d: mentions(s, d).select("mention_id", "run_id", "surface", "start_offset", "end_offset"), f"WITH {M_SQL} SELECT mention_id, run_id, surface, start_offset, end_offset FROM mentions", "evidence", as_json=True)


def chat_log(s, d) -> DataFrame:
    """One line for every user message: tag, and compact JSON of conversation, k and the query's hash."""
    asked = read(s, d, "conversations").where("role = 'user'")
    line = F.concat(F.lit('RAG_CHAT_EVIDENCE {"k":5,"query_hash":"'), F.substring(F.sha2("text", 256), 1, 12), F.lit('","run_id":'), F.col("conv_id").cast("string"), F.lit("}"))
    return asked.select("conv_id", "turn", line.alias("line"))


sink("R6_chat_evidence_log", chat_log, "SELECT conv_id, turn, concat('RAG_CHAT_EVIDENCE {\"k\":5,\"query_hash\":\"', substr(sha256(text), 1, 12), '\",\"run_id\":', conv_id, '}') AS line FROM conversations WHERE role = 'user'", "chat-log", as_json=True)


def frames(s, d) -> DataFrame:
    """Every assistant message as the frames of an event stream: a delta for each word, then the end."""
    said = read(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(T.tokens(F.regexp_replace("text", r'[\\"\x00-\x1f]', " ")), F.array(F.lit(None).cast("string"))).alias("w"))
    each = said.select("conv_id", "turn", F.posexplode("w").alias("i", "w"))
    frame = F.when(F.col("w").isNull(), 'data: {"type":"done"}\n\n').otherwise(F.concat(F.lit('data: {"type":"delta","text":"'), "w", F.lit('"}\n\n')))
    return each.select("conv_id", "turn", "i", frame.alias("frame"))


register(
    "R3_event_frames",
    frames,
    f"WITH a AS (SELECT conv_id, turn, list_concat({Q.tokens('regexp_replace(text, ' + chr(39) + '[' + chr(92) * 2 + chr(34) + chr(92) + 'x00-' + chr(92) + 'x1f]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, [NULL]) AS w FROM conversations WHERE role = 'assistant'), "
    "e AS (SELECT conv_id, turn, unnest(range(len(w)))::INT AS i, unnest(w) AS w FROM a) SELECT conv_id, turn, i, CASE WHEN w IS NULL THEN 'data: {\"type\":\"done\"}' ELSE concat('data: {\"type\":\"delta\",\"text\":\"', w, '\"}') END || chr(10) || chr(10) AS frame FROM e",
)

# ---- spans (S44, S45) -----------------------------------------------------------------------


def spans(s, d) -> DataFrame:
    """Spans of mentions with their region folded into JSON, listed by page."""
    meta = F.concat(F.lit('{"region_id":'), F.col("part").cast("string"), F.lit("}"))
    rows = mentions(s, d).select(F.sha2(F.concat_ws("|", "run_id", "surface", "start_offset", "end_offset"), 256).alias("span_id"), F.col("run_id").alias("page_id"), "mention_id", "surface", "start_offset", "end_offset", meta.alias("meta_json"))
    return S.first_by_key(rows, ["span_id"], [F.col("mention_id")])


SPANS = f"{M_SQL}, spans AS (SELECT sha256(concat_ws('|', run_id, surface, start_offset, end_offset)) AS span_id, run_id AS page_id, mention_id, surface, start_offset, end_offset, concat('{{\"region_id\":', part, '}}') AS meta_json FROM mentions QUALIFY row_number() OVER (PARTITION BY run_id, surface, start_offset, end_offset ORDER BY mention_id) = 1)"
register("S44_create_spans", spans, f"WITH {SPANS} SELECT * FROM spans")
register("S45_spans_of_page", lambda s, d: S.scan(spans(s, d), {"page_id": 7}, [F.col("start_offset"), F.col("span_id")]), f"WITH {SPANS} SELECT * FROM spans WHERE page_id = 7 ORDER BY start_offset, span_id")

# ---- entities (A26, N9, N10) -------------------------------------------------------------------


def persisted(s, d) -> DataFrame:
    """What a linked candidate adds: an entity row, its aliases (label, surface, source aliases) and two to eight assertions, as one long table."""
    linked = candidates(s, d).where("compatible AND score >= 0.85")
    key = F.concat_ws(":", "source", "cand_key")
    row = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    parts = F.array(
        row("entity", "canonical_label", F.col("label")), row("alias", "label", F.lower("label")), row("alias", "surface", F.lower("surface")), row("alias", "source", F.lower(F.regexp_replace("label", " .*$", ""))),
        row("assertion", "authority_id", key), row("assertion", "entity_type", F.col("ent_type")), row("assertion", "description", F.col("description")),
        row("assertion", "viaf_id", F.when(F.col("source") == "viaf", F.col("cand_key"))), row("assertion", "geonames_id", F.when(F.col("source") == "geonames", F.col("cand_key"))), row("assertion", "wikidata_qid", F.when(F.col("source") == "wikidata", F.concat(F.lit("Q"), "cand_key"))),
    )
    return linked.select(key.alias("entity_id"), F.explode(F.filter(parts, lambda p: p["value"].isNotNull() & (p["value"] != ""))).alias("p")).select("entity_id", "p.*").distinct()


register(
    "A26_persisted_entities",
    persisted,
    f"WITH {C_SQL}, l AS (SELECT *, concat_ws(':', source, cand_key) AS entity_id FROM candidates WHERE compatible AND score >= 0.85e0), u AS (SELECT entity_id, 'entity' AS kind, 'canonical_label' AS name, label AS value FROM l UNION SELECT entity_id, 'alias', 'label', lower(label) FROM l UNION SELECT entity_id, 'alias', 'surface', lower(surface) FROM l UNION SELECT entity_id, 'alias', 'source', lower(regexp_replace(label, ' .*$', '')) FROM l "
    "UNION SELECT entity_id, 'assertion', 'authority_id', entity_id FROM l UNION SELECT entity_id, 'assertion', 'entity_type', ent_type FROM l UNION SELECT entity_id, 'assertion', 'description', description FROM l UNION SELECT entity_id, 'assertion', 'viaf_id', cand_key::VARCHAR FROM l WHERE source = 'viaf' UNION SELECT entity_id, 'assertion', 'geonames_id', cand_key::VARCHAR FROM l WHERE source = 'geonames' UNION SELECT entity_id, 'assertion', 'wikidata_qid', concat('Q', cand_key) FROM l WHERE source = 'wikidata') SELECT * FROM u WHERE value <> ''",
)
CLAIM = "map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string,latitude:string,longitude:string>>>>>>"


def claim_json(key: Column) -> Column:
    """Claims as an authority gives them: types, some without an id, and coordinates, some of them not numbers."""
    k = key.cast("string")
    value = lambda *parts: F.concat(F.lit('{"mainsnak":{"datavalue":{"value":{'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("}}}}"))
    types = F.concat(value('"id":"Q', k, '"'), F.lit(","), F.when(key % 3 == 0, value('"note":"x"')).otherwise(value('"id":"Q5"')))
    place = F.concat(F.when(key % 4 == 0, F.concat(value('"latitude":"north","longitude":"1"'), F.lit(","))).otherwise(""), value('"latitude":', (key % 90).cast("string"), ',"longitude":', (key % 180).cast("string")))
    return F.concat(F.lit('{"P31":['), types, F.lit("]"), F.when(key % 5 != 0, F.concat(F.lit(',"P625":['), place, F.lit("]"))).otherwise(""), F.lit("}"))


def claims(s, d) -> DataFrame:
    """Ids of a property, and the first coordinates that are numbers."""
    c = read(s, d, "customer").select("c_custkey", F.from_json(claim_json(F.col("c_custkey")), CLAIM).alias("c"))
    value = lambda x: x["mainsnak"]["datavalue"]["value"]
    ids = F.filter(F.transform(F.try_element_at("c", F.lit("P31")), lambda x: value(x)["id"]), lambda x: x.isNotNull() & (x != ""))
    pairs = F.transform(F.try_element_at("c", F.lit("P625")), lambda x: F.struct(F.expr("1.0D").alias("one"), value(x)["latitude"].try_cast("double").alias("lat"), value(x)["longitude"].try_cast("double").alias("lon")))
    first = F.try_element_at(F.filter(pairs, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.lit(1))
    return c.select("c_custkey", F.array_join(ids, ",").alias("ids"), first["lat"].alias("latitude"), first["lon"].alias("longitude"))


register(
    "N9_N10_claims",
    claims,
    "SELECT c_custkey, concat_ws(',', 'Q' || c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'Q5' END) AS ids, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 90)::DOUBLE END AS latitude, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 180)::DOUBLE END AS longitude FROM customer",
)

# ---- salvaged replies (N5, N6) ------------------------------------------------------------------
LABELLED = {"assessment": "assessment", "verified_answer": "(?:verified answer|corrected answer|answer)", "notes": "notes?", "citations_checked": "citations?\\s*checked"}
ASSESSMENTS = ["supported", "partially_supported", "unsupported", "unavailable"]


def stripped(x: Column) -> Column:
    """Without leaked reasoning and fences, on one line."""
    x = F.regexp_replace(x, r"(?is)<\s*(think|analysis|scratchpad)\b[^>]*>.*?<\s*/\s*\1\s*>", " ")
    x = F.regexp_replace(x, r"(?im)^\s*(reasoning|analysis|scratchpad|chain[\s-]*of[\s-]*thought|internal reasoning|thought process)\s*:\s*.*$", " ")
    x = F.regexp_replace(F.regexp_replace(x, "(?i)```(?:json)?", " "), r"(?i)\b(let'?s think step by step|hidden chain of thought|private reasoning)\b", " ")
    return F.regexp_replace(T.collapse(x), r"^[ \-:\n\t]+|[ \-:\n\t]+$", "")


def salvaged(raw: Column, name: str) -> Column:
    """The value behind a label at the start of a line; null without one."""
    found = stripped(F.regexp_extract(raw, rf"(?im)^\s*{LABELLED[name]}\s*:\s*(\S.*?)\s*$", 1))
    return F.when(found != "", found)


def listed(value: Column, most: int) -> Column:
    """The parts of a list of up to 300 signs each, no part twice, the first ``most``."""
    parts = F.filter(F.transform(F.split(value, r"\s*[;•]\s*|\s*,\s*|\s+\|\s+"), lambda p: F.substring(stripped(p), 1, 300)), lambda p: p != "")
    return F.slice(F.array_distinct(F.coalesce(parts, F.array().cast("array<string>"))), 1, most)


def verification(raw: Column, draft: Column) -> list[Column]:
    """Assessment, answer, at most four notes and six citations, from JSON if the reply holds some, else from labelled lines."""
    blob = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "assessment string, corrected_answer string, verified_answer string, notes array<string>, citations_checked array<string>")
    json = lambda c: F.nullif(blob[c], F.lit(""))
    anything = F.greatest(*[json(c).isNotNull() for c in ("assessment", "corrected_answer", "verified_answer")], *[salvaged(raw, n).isNotNull() for n in LABELLED])
    told = F.lower(F.coalesce(json("assessment"), salvaged(raw, "assessment"), F.lit("unavailable")))
    answer = stripped(F.coalesce(json("corrected_answer"), json("verified_answer"), salvaged(raw, "verified_answer"), draft))
    clean = lambda c, most: F.slice(F.array_distinct(F.filter(F.transform(blob[c], lambda x: F.substring(stripped(x), 1, 300)), lambda x: x != "")), 1, most)
    some = lambda c, most: F.when(F.size(clean(c, most)) > 0, clean(c, most)).otherwise(listed(salvaged(raw, c), most))
    notes = F.when(~anything, lit(["Verifier response could not be parsed cleanly."])).when(F.size(some("notes", 4)) > 0, some("notes", 4)).otherwise(lit(["Verification completed without additional notes."]))
    return [F.when(told.isin(*ASSESSMENTS), told).otherwise("partially_supported").alias("assessment"), F.when(answer == "", draft).otherwise(answer).alias("answer"), F.array_join(notes, " / ").alias("notes"), F.array_join(F.when(anything, some("citations_checked", 6)).otherwise(F.array().cast("array<string>")), " / ").alias("citations")]


REPLIES = [
    "Assessment: Supported\nAnswer:  it says Artus \nNotes: clear; clear, worn | torn • faded, extra\nCitations checked: c1, c2; c1",
    "no labels here", "Reasoning: because\nassessment : doubtful\nCorrected answer: <think>x</think> yes", '{"assessment": "unsupported", "verified_answer": "no", "notes": ["a", "a", "b", "c", "d", "e"]}',
    "Note: only a note", "",
]
WANTED = [
    ("supported", "it says Artus", "clear / worn / torn / faded", "c1 / c2"), ("unavailable", None, "Verifier response could not be parsed cleanly.", ""), ("partially_supported", "yes", "Verification completed without additional notes.", ""),
    ("unsupported", "no", "a / b / c / d", ""), ("unavailable", None, "only a note", ""), ("unavailable", None, "Verifier response could not be parsed cleanly.", ""),
]
reply = lambda key: F.element_at(lit(REPLIES), (key % len(REPLIES) + 1).cast("int"))
register("N6_verification_payload", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", reply(F.col("conv_id") + F.col("turn")).alias("raw"), F.concat(F.lit("draft "), F.col("turn").cast("string")).alias("draft")).select("conv_id", "turn", *verification(F.col("raw"), F.col("draft"))),
    "SELECT conv_id, turn, " + ", ".join(f"CASE (conv_id + turn) % {len(REPLIES)} " + " ".join(f"WHEN {i} THEN " + ("concat('draft ', turn)" if w[k] is None else f"'{w[k]}'") for i, w in enumerate(WANTED)) + f" END AS {name}" for k, name in enumerate(("assessment", "answer", "notes", "citations"))) + " FROM conversations")
register("N5_salvaged_fields", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", reply(F.col("conv_id") + F.col("turn")).alias("raw")).select("conv_id", "turn", *[salvaged(F.col("raw"), n).alias(n) for n in LABELLED]),
    f"SELECT conv_id, turn, CASE k WHEN 0 THEN 'Supported' WHEN 2 THEN 'doubtful' END AS assessment, CASE k WHEN 0 THEN 'it says Artus' WHEN 2 THEN 'yes' END AS verified_answer, CASE k WHEN 0 THEN 'clear; clear, worn | torn • faded, extra' WHEN 4 THEN 'only a note' END AS notes, CASE k WHEN 0 THEN 'c1, c2; c1' END AS citations_checked FROM (SELECT *, (conv_id + turn) % {len(REPLIES)} AS k FROM conversations)")

# ---- curated mentions (M6, R8) -------------------------------------------------------------------
#: Listed surfaces in their order; a phrase may hold a later word.
LISTED = ["of the", "the", "er", "in", "la"]


def curated(docs: DataFrame) -> DataFrame:
    """For every listed surface of a text, in order, its first place that overlaps none taken before: whole words first, then any place."""
    text = docs.select("doc_id", "text")
    found = None
    for k, surface in enumerate(LISTED):
        every = X.occurrences(text, surface).select("doc_id", F.lit(k).alias("k"), F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
        if " " not in surface:
            whole = X.occurrences(text, f"{X.EDGE[0]}{surface}{X.EDGE[1]}").select("doc_id", F.lit(k).alias("k"), F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
            every = whole.unionByName(every.join(whole.select("doc_id").distinct(), "doc_id", "left_anti"))
        # A span taken before covers no more places than it and the surface have signs, so the first few suffice.
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("s"))
        every = every.withColumn("r", rank).where(F.col("r") <= 1 + sum(len(x) + len(surface) for x in LISTED[:k])).drop("r")
        found = every if found is None else found.unionByName(every)
    places = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "s", "e"))).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda q: (q["k"] == x["k"]) | ((x["s"] < q["e"]) & (x["e"] > q["s"])))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = places.select("doc_id", F.explode(kept).alias("p"))
    return rows.select("doc_id", F.col("p.s").alias("start_offset"), F.col("p.e").alias("end_offset"), F.element_at(lit(LISTED), F.col("p.k") + 1).alias("surface"), F.col("p.k").alias("place"))


def q_places(surface: str) -> str:
    spelled = " AND ".join(f"c[i + {k + 1}] = '{x}'" for k, x in enumerate(surface))
    at = lambda cond: f"list_filter(range(0, len(c) - {len(surface) - 1}), lambda i: {spelled}{cond})"
    edge = rf" AND NOT regexp_matches(coalesce(c[i], ''), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(coalesce(c[i + {len(surface) + 1}], ''), '[\p{{L}}\p{{N}}_]')"
    if " " in surface:
        return at("")
    return f"CASE WHEN len({at(edge)}) > 0 THEN {at(edge)} ELSE {at('')} END"


def q_curated() -> str:
    steps = ["c0 AS (SELECT doc_id, string_split(text, '') AS c, [] :: INT[][] AS taken FROM docs)"]
    for k, surface in enumerate(LISTED):
        n = len(surface)
        steps.append(f"p{k} AS (SELECT *, list_filter({q_places(surface)}, lambda i: len(list_filter(taken, lambda q: i < q[2] AND i + {n} > q[1])) = 0)[1] AS hit FROM c{k})")
        steps.append(f"c{k + 1} AS (SELECT doc_id, c, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, [hit::INT, (hit + {n})::INT, {k}]) END AS taken FROM p{k})")
    return f"{DOCS}, " + ", ".join(steps) + f", cur AS (SELECT doc_id, m[1] AS start_offset, m[2] AS end_offset, {Q.array(LISTED)}[m[3] + 1] AS surface, m[3] AS place FROM (SELECT doc_id, unnest(taken) AS m FROM c{len(LISTED)}))"


register("M6_curated_mentions", lambda s, d: curated(documents(s, d)), f"WITH {q_curated()} SELECT * FROM cur")


def curated_run(s, d) -> DataFrame:
    """Curated mentions with the chunk that holds their start and a decision that skips linking."""
    chunks = X.line_chunks(documents(s, d)).select("doc_id", "idx", F.col("start_offset").alias("a"), F.col("end_offset").alias("b"))
    m = curated(documents(s, d)).alias("m")
    held = m.join(chunks.alias("c"), (F.col("m.doc_id") == F.col("c.doc_id")) & (F.col("start_offset") >= F.col("a")) & (F.col("end_offset") <= F.col("b")), "left")
    return held.select("m.doc_id", "start_offset", "end_offset", "surface", F.col("idx").alias("chunk"), F.lit("SKIP_NON_LINKABLE").alias("status"), F.lit(0.99).alias("confidence"))


register("R8_curated_run", curated_run, f"WITH {q_curated()}, {CHUNKS.removeprefix(DOCS + ', ')} SELECT cur.doc_id, cur.start_offset, cur.end_offset, surface, idx AS chunk, 'SKIP_NON_LINKABLE' AS status, 0.99e0 AS confidence FROM cur LEFT JOIN chunks ON chunks.doc_id = cur.doc_id AND cur.start_offset >= chunks.start_offset AND cur.end_offset <= chunks.end_offset")

# ---- reports and evidence (R7, T94, V8, V9, J17) ------------------------------------------------


def consolidated(s, d) -> DataFrame:
    """Per run: decisions by status, the three surest accepted surfaces, links by source, and whether the audit holds.

    A mention_id can occur twice; of such equals the first surface by its letters comes first, whatever the order of the rows.
    """
    dec = decisions(s, d)
    by_status = dec.groupBy("run_id", "status").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "n"))), " ").alias("extraction"))
    best = dec.where("status = 'ACCEPT_LINKABLE'").withColumn("r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("confidence").desc(), "mention_id", "surface"))).where("r <= 3")
    top = best.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "surface"))), lambda x: x["surface"]), ",").alias("top"))
    links = candidates(s, d).where("compatible AND score >= 0.85").groupBy("run_id", "source").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "n"))), " ").alias("linking"))
    audit = dec.groupBy("run_id").agg((F.count("*") == F.countDistinct("mention_id")).alias("unique"), F.bool_and(F.col("surface") != "").alias("named"))
    return by_status.join(top, "run_id", "left").join(links, "run_id", "left").join(audit, "run_id").select("run_id", F.concat_ws("\n", "extraction", F.concat(F.lit("top: "), F.coalesce("top", F.lit("none"))), F.concat(F.lit("links: "), F.coalesce("linking", F.lit("none"))), F.when(F.col("unique") & F.col("named"), "AUDIT PASS").otherwise("AUDIT FAIL")).alias("report"))


register(
    "R7_consolidated_report",
    consolidated,
    f"WITH {C_SQL}, {D_SQL.removeprefix(M_SQL + ', ')}, st AS (SELECT run_id, string_agg(concat_ws('=', status, n), ' ' ORDER BY concat_ws('=', status, n)) AS extraction FROM (SELECT run_id, status, count(*) AS n FROM decisions GROUP BY 1, 2) GROUP BY 1), "
    "bt AS (SELECT run_id, string_agg(surface, ',' ORDER BY r) AS top FROM (SELECT run_id, surface, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, mention_id) AS r FROM decisions WHERE status = 'ACCEPT_LINKABLE') WHERE r <= 3 GROUP BY 1), "
    "lk AS (SELECT run_id, string_agg(concat_ws('=', source, n), ' ' ORDER BY concat_ws('=', source, n)) AS linking FROM (SELECT run_id, source, count(*) AS n FROM candidates WHERE compatible AND score >= 0.85e0 GROUP BY 1, 2) GROUP BY 1), au AS (SELECT run_id, count(*) = count(DISTINCT mention_id) AS uniq, bool_and(surface <> '') AS named FROM decisions GROUP BY 1) "
    "SELECT st.run_id, concat_ws(chr(10), extraction, concat('top: ', coalesce(top, 'none')), concat('links: ', coalesce(linking, 'none')), CASE WHEN uniq AND named THEN 'AUDIT PASS' ELSE 'AUDIT FAIL' END) AS report FROM st LEFT JOIN bt USING (run_id) LEFT JOIN lk USING (run_id) JOIN au USING (run_id)",
)


def top_rows(s, d, k: int, where: str = "true") -> DataFrame:
    queries = vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search(vectors(s, d).where(where), queries, k)


def blocks(rows: DataFrame) -> DataFrame:
    """Retrieved rows of a query as citation blocks, best first."""
    block = F.concat(
        F.lit("[OCR_CHUNK_EVIDENCE]\nrun_id: "), F.col("label").cast("string"), F.lit("\nasset_ref: asset-"), F.col("label").cast("string"), F.lit("\nchunk_id: "), F.col("vec_id").cast("string"), F.lit("\noffsets: "), (F.col("vec_id") * 10).cast("string"), F.lit("-"),
        (F.col("vec_id") * 10 + 9).cast("string"), F.lit("\nretrieval_score: "), F.format_string("%.4f", "score"), F.lit("\ntext: vector "), F.col("vec_id").cast("string"), F.lit("\n[/OCR_CHUNK_EVIDENCE]"),
    )
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("evidence"))


Q_BLOCK = "concat('[OCR_CHUNK_EVIDENCE]', chr(10), 'run_id: ', label, chr(10), 'asset_ref: asset-', label, chr(10), 'chunk_id: ', vec_id, chr(10), 'offsets: ', vec_id * 10, '-', vec_id * 10 + 9, chr(10), 'retrieval_score: ', printf('%.4f', score), chr(10), 'text: vector ', vec_id, chr(10), '[/OCR_CHUNK_EVIDENCE]')"
Q_BLOCKS = f"SELECT query_id, string_agg({Q_BLOCK}, chr(10) || chr(10) ORDER BY score DESC, vec_id) AS evidence FROM"
register("T94_evidence_blocks", lambda s, d: blocks(top_rows(s, d, 5)), f"{Q_BLOCKS} ({q_top(5)}) GROUP BY 1")


def last_questions(s, d) -> DataFrame:
    """The last user message of each conversation and the vector that it is asked with."""
    asked = read(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    ids = vectors(s, d).where("vec_id % 50 = 0").select("vec_id").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return asked.crossJoin(F.broadcast(ids)).select("conv_id", "query", F.element_at("ids", (F.col("conv_id") % F.size("ids") + 1).cast("int")).alias("query_id"))


LAST_ASKED = "ask AS (SELECT conv_id, max_by(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1), ids AS (SELECT list(vec_id ORDER BY vec_id) AS ids FROM embeddings WHERE vec_id % 50 = 0), lq AS (SELECT conv_id, query, ids[(conv_id % len(ids) + 1)::INT] AS query_id FROM ask, ids)"
register(
    "V9_retrieved_evidence",
    lambda s, d: last_questions(s, d).join(blocks(top_rows(s, d, 5)), "query_id").join(blocks(top_rows(s, d, 4, "label IN (1, 2, 3)")).withColumnRenamed("evidence", "entities"), "query_id", "left").select("conv_id", "query", F.sha2(F.concat_ws("\n\n", "evidence", "entities"), 256).alias("sha")),
    f"WITH {LAST_ASKED}, ch AS ({Q_BLOCKS} ({q_top(5)}) GROUP BY 1), en AS ({Q_BLOCKS} ({q_top(4, 'label IN (1, 2, 3)')}) GROUP BY 1) SELECT conv_id, query, sha256(concat_ws(chr(10) || chr(10), ch.evidence, en.evidence)) AS sha FROM lq JOIN ch USING (query_id) LEFT JOIN en USING (query_id)",
)


def structured(s, d) -> DataFrame:
    """Per question and entity: the linked mentions of retrieved runs, else of surfaces that the question names, else the four surest of all.

    A run is a vector's label here, an entity a surface.
    """
    asked = last_questions(s, d)
    linked = decisions(s, d).where("status = 'ACCEPT_LINKABLE'").withColumn("label", (F.col("run_id") % 10).cast("int"))
    best = linked.groupBy("label", F.col("surface").alias("entity")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    hits = top_rows(s, d, 5).where("score >= 0.2 AND label < 5").select("query_id", "label").distinct()
    by_hit = asked.join(hits, "query_id").join(best, "label").groupBy("conv_id", "entity").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("n"), F.lit("hit").alias("way"))
    rest = asked.join(by_hit.select("conv_id").distinct(), "conv_id", "left_anti")
    whole = best.groupBy("entity").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("n"))
    words = rest.select("conv_id", F.explode(F.array_distinct(F.split(F.upper("query"), "[^A-Z0-9]+"))).alias("entity"))
    by_word = words.join(whole, "entity").select("conv_id", "entity", "confidence", "n", F.lit("keyword").alias("way"))
    none = rest.select("conv_id").join(by_word.select("conv_id").distinct(), "conv_id", "left_anti")
    four = whole.orderBy(F.col("confidence").desc(), F.col("n").desc(), "entity").limit(4)
    return by_hit.unionByName(by_word).unionByName(none.crossJoin(F.broadcast(four)).select("conv_id", "entity", "confidence", "n", F.lit("fallback").alias("way")))


STRUCTURED = (
    f"{LAST_ASKED}, {D_SQL}, be AS (SELECT (run_id % 10)::INT AS label, surface AS entity, max(confidence) AS confidence, count(*) AS n FROM decisions WHERE status = 'ACCEPT_LINKABLE' GROUP BY 1, 2), hi AS (SELECT DISTINCT query_id, label FROM ({q_top(5)}) WHERE score >= 0.2e0 AND label < 5), "
    "bh AS (SELECT conv_id, entity, max(confidence) AS confidence, sum(n)::BIGINT AS n, 'hit' AS way FROM lq JOIN hi USING (query_id) JOIN be USING (label) GROUP BY 1, 2), rs AS (SELECT * FROM lq WHERE conv_id NOT IN (SELECT conv_id FROM bh)), wh AS (SELECT entity, max(confidence) AS confidence, sum(n)::BIGINT AS n FROM be GROUP BY 1), "
    "wd AS (SELECT conv_id, unnest(list_distinct(string_split_regex(upper(query), '[^A-Z0-9]+'))) AS entity FROM rs), bw AS (SELECT conv_id, entity, confidence, n, 'keyword' AS way FROM wd JOIN wh USING (entity)), fo AS (SELECT * FROM wh ORDER BY confidence DESC, n DESC, entity LIMIT 4), "
    "sec AS (SELECT * FROM bh UNION ALL SELECT * FROM bw UNION ALL SELECT conv_id, entity, confidence, n, 'fallback' FROM rs, fo WHERE conv_id NOT IN (SELECT conv_id FROM bw))"
)
register("J17_structured_sections", structured, f"WITH {STRUCTURED} SELECT * FROM sec")


def evidence_payload(s, d) -> DataFrame:
    """Three strata for each question: chunks with score and distance, entities, and structured sections."""
    chunks = top_rows(s, d, 8).groupBy("query_id").agg(F.count("*").alias("chunks"), F.max("score").alias("best"), F.round(1 - F.max("score"), 4).alias("distance"))
    entities = top_rows(s, d, 4, "label IN (1, 2, 3)").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ",").alias("entities"))
    sections = structured(s, d).groupBy("conv_id").agg(F.count("*").alias("sections"), F.min("way").alias("way"))
    return last_questions(s, d).join(chunks, "query_id").join(entities, "query_id", "left").join(sections, "conv_id", "left").select("conv_id", "query_id", "chunks", "best", "distance", "entities", F.coalesce("sections", F.lit(0)).alias("sections"), "way")


register(
    "V8_evidence_payload",
    evidence_payload,
    f"WITH {STRUCTURED}, ch AS (SELECT query_id, count(*) AS chunks, max(score) AS best, round(1 - max(score), 4) AS distance FROM ({q_top(8)}) GROUP BY 1), en AS (SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS entities FROM ({q_top(4, 'label IN (1, 2, 3)')}) GROUP BY 1), sc AS (SELECT conv_id, count(*) AS sections, min(way) AS way FROM sec GROUP BY 1) "
    "SELECT conv_id, query_id, chunks, best, distance, entities, coalesce(sections, 0) AS sections, way FROM lq JOIN ch USING (query_id) LEFT JOIN en USING (query_id) LEFT JOIN sc USING (conv_id)",
)
