"""Cosine retrieval over ``embeddings`` and chat selection over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from palimpsest.plans.store import read
from palimpsest.registry import register


def vectors(s, d):
    return read(s, d, "embeddings")


register("V4_V6_index_counts", lambda s, d: vectors(s, d).groupBy("label").agg(F.count("*").alias("indexed"), F.min(F.size("embedding")).alias("width")), "SELECT label, count(*) AS indexed, min(len(embedding))::INT AS width FROM embeddings GROUP BY 1")


def talks(s, d):
    return read(s, d, "conversations")




def inspect():
    return F.col("text").rlike("(?i)print the rag|show (the )?evidence|^the ")
Q_INSPECT = "regexp_matches(text, '(?i)print the rag|show (the )?evidence|^the ')"
register("V10_latest_user_query", lambda s, d: talks(s, d).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query")), "SELECT conv_id, text AS query FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
register("V11_substantive_query", lambda s, d: talks(s, d).where((F.col("role") == "user") & ~inspect()).groupBy("conv_id").agg(F.max_by("text", "turn").alias("query")), f"SELECT conv_id, text AS query FROM conversations WHERE role = 'user' AND NOT {Q_INSPECT} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
register("P29_inspection_query", lambda s, d: talks(s, d).select("conv_id", "turn", inspect().alias("inspection")), f"SELECT conv_id, turn, {Q_INSPECT} AS inspection FROM conversations")
register("P46_asks_for_text", lambda s, d: talks(s, d).select("conv_id", "turn", F.col("text").rlike("(?i)read|transcri|text|what does").alias("asks")), "SELECT conv_id, turn, regexp_matches(text, '(?i)read|transcri|text|what does') AS asks FROM conversations")
register("N19_N20_flattened_results", lambda s, d: talks(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", F.explode("r").alias("x")).select("conv_id", "x.turn", "x.role"), "SELECT conv_id, turn, role FROM conversations")
register("C8_command_intent", lambda s, d: talks(s, d).select("conv_id", "turn", F.when(F.lower("text").rlike("transl"), "translate").when(F.lower("text").rlike("segment|layout"), "segment").when(F.lower("text").rlike("who|where|name"), "entities").otherwise("chat").alias("intent")), "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'transl') THEN 'translate' WHEN regexp_matches(lower(text), 'segment|layout') THEN 'segment' WHEN regexp_matches(lower(text), 'who|where|name') THEN 'entities' ELSE 'chat' END AS intent FROM conversations")


def props():
    return F.from_json("props", "k int")


register("N1_lenient_json", lambda s, d: read(s, d, "events").select("event_id", F.coalesce(props()["k"], F.lit(-1)).alias("k"), F.when(props()["k"].isNull(), "MISSING_KEY").alias("warning")), "SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'MISSING_KEY' END AS warning FROM events")
register("N2_strict_keys", lambda s, d: read(s, d, "events").select("event_id", F.when(F.array_join(F.json_object_keys("props"), ",") == "k", F.get_json_object("props", "$.k").cast("int")).alias("k")), "SELECT event_id, CASE WHEN array_to_string(json_keys(props), ',') = 'k' THEN json_extract_string(props, '$.k')::INT END AS k FROM events")
register("N3_N4_T100_json_candidate", lambda s, d: read(s, d, "events").select("event_id", F.regexp_extract(F.concat(F.lit("noise "), "props", F.lit(" tail")), r"(?s)\{.*\}", 0).alias("blob")), r"SELECT event_id, regexp_extract(concat('noise ', props, ' tail'), '(?s)\{.*\}') AS blob FROM events")
register("N12_json_or_none", lambda s, d: read(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct("event_type"))).alias("payload")), "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN json_object('event_type', event_type)::VARCHAR END AS payload FROM events")


def langs():
    return F.map_from_arrays(F.array(F.lit("de"), F.when(F.col("event_id") % 2 == 0, "fr").otherwise("it")), F.array("event_type", F.upper("event_type")))
register("N7_best_language_value", lambda s, d: read(s, d, "events").withColumn("m", langs()).select("event_id", F.coalesce(F.try_element_at("m", F.lit("en")), F.try_element_at("m", F.lit("fr")), F.try_element_at("m", F.lit("de")), F.map_values("m")[0]).alias("value")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS value FROM events")
register("N8_flat_aliases", lambda s, d: read(s, d, "events").select(F.explode(langs()).alias("lang", "alias")).select("lang", F.lower("alias").alias("alias")).dropDuplicates(), "SELECT DISTINCT lang, lower(alias) AS alias FROM (SELECT 'de' AS lang, event_type AS alias FROM events UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'fr' ELSE 'it' END, upper(event_type) FROM events)")
register("T83_T84_clean_model_output", lambda s, d: read(s, d, "pages").select("page_id", F.sha2(F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")), 256).alias("sha")), r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'))) AS sha FROM pages")
register("T89_parse_notes", lambda s, d: read(s, d, "part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("nd="), (F.col("p_size") / 100).cast("string")), F.concat(F.lit("canonical="), F.lower("p_brand"))).alias("notes")).select("p_partkey", F.regexp_extract("notes", r"nd=([0-9.]+)", 1).cast("double").alias("nd"), F.regexp_extract("notes", r"canonical=(\S+)", 1).alias("canonical")), r"SELECT p_partkey, p_size::DOUBLE / 100 AS nd, regexp_extract(lower(p_brand), '^(\S+)', 1) AS canonical FROM part")
register("T92_T93_slugs", lambda s, d: read(s, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "_").alias("slug")), "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS slug FROM part")
register("P11_relevant_label", lambda s, d: read(s, d, "part").select("p_partkey", (~F.lower("p_type").rlike("plated|polished") & F.lower("p_type").rlike("steel|brass|tin")).alias("relevant")), "SELECT p_partkey, NOT regexp_matches(lower(p_type), 'plated|polished') AND regexp_matches(lower(p_type), 'steel|brass|tin') AS relevant FROM part")


def plans_for(s, d):
    """Language hint to ordered back ends by a small fixed table."""
    table = s.createDataFrame([("en", "kraken,glm"), ("fr", "calamari,kraken,glm"), ("de", "calamari,glm")], "lang string, backends string")
    return read(s, d, "documents").join(F.broadcast(table), "lang", "left").select("doc_id", F.coalesce("backends", F.lit("glm")).alias("backends"))


register("P41_P43_hint_flags", lambda s, d: read(s, d, "documents").select("doc_id", F.col("lang").contains("la").alias("latin_lock"), F.col("lang").isin("fr", "fro", "frm", "xno").alias("french_family")), "SELECT doc_id, contains(lang, 'la') AS latin_lock, lang IN ('fr', 'fro', 'frm', 'xno') AS french_family FROM documents")

# ---- change detection (batch form of the streams) -----------------------------------------


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


register("R1_R2_changed_snapshots", lambda s, d: read(s, d, "events").withColumn("before", F.lag("event_type").over(by_user())).where(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")


def so_far():
    return F.array_join(F.collect_list("event_type").over(by_user().rowsBetween(-2, 0)), "")
register("R4_stream_delta", lambda s, d: read(s, d, "events").withColumn("now", so_far()).withColumn("old", F.coalesce(F.lag("now").over(by_user()), F.lit(""))).select("event_id", F.when(F.col("now").startswith(F.col("old")), F.expr("substring(now, length(old) + 1)")).otherwise(F.col("now")).alias("delta")), "SELECT event_id, CASE WHEN starts_with(now, old) THEN substr(now, length(old) + 1) ELSE now END AS delta FROM (SELECT event_id, now, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS old FROM (SELECT *, string_agg(event_type, '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS now FROM events))")
register("R5_task_ttl", lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(read(s, d, "events").agg(F.max("ts").alias("now")))).select("user_id", (F.col("last") < F.col("now") - F.expr("INTERVAL 1 DAY")).alias("expired")), "SELECT user_id, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM events GROUP BY 1")
