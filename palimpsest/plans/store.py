"""Store operators over tables derived from the driver's star schema.

orders are runs, lineitem mentions (with candidates, decisions and attempts
derived from them), events the event log and the visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import store as S
from palimpsest.registry import register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("asset-"), "o_custkey").alias("asset_ref"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("total"))


def events(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), "ts", F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "END").otherwise("START").alias("event"), "value")


def mentions(spark, d):
    start = F.col("l_partkey") % 1000
    kind = F.when(F.col("l_returnflag") == "A", "person").when(F.col("l_returnflag") == "N", "place").otherwise("date")
    return read(spark, d, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")).alias("mention_id"), F.col("l_orderkey").alias("run_id"), start.alias("start_offset"), (start + F.col("l_quantity").cast("long")).alias("end_offset"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 50).alias("surface"), kind.alias("ent_type"), F.round(F.col("l_discount") * 10, 4).alias("confidence"), F.when(F.col("l_linestatus") == "O", "rule:trigger").otherwise("rule:capital").alias("method"), F.col("l_shipdate").alias("created_at"), F.col("l_partkey").alias("part"),
    )


M_SQL = (
    "mentions AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS mention_id, l_orderkey AS run_id, l_partkey % 1000 AS start_offset, l_partkey % 1000 + l_quantity::BIGINT AS end_offset, concat('S', l_suppkey % 50) AS surface, "
    "CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'place' ELSE 'date' END AS ent_type, round(l_discount * 10, 4) AS confidence, CASE WHEN l_linestatus = 'O' THEN 'rule:trigger' ELSE 'rule:capital' END AS method, l_shipdate AS created_at, l_partkey AS part FROM lineitem)"
)
R_SQL = "runs AS (SELECT o_orderkey AS run_id, concat('asset-', o_custkey) AS asset_ref, o_orderstatus AS status, o_orderpriority AS stage, o_orderdate AS updated_at, o_totalprice AS total FROM orders)"
E_SQL = "ev AS (SELECT event_id AS id, user_id AS run_id, ts, event_type AS stage, CASE WHEN event_id % 3 = 0 THEN 'END' ELSE 'START' END AS event, value FROM events)"


def decisions(spark, d):
    m = mentions(spark, d)
    status = F.when(F.col("confidence") >= 0.7, "ACCEPT_LINKABLE").when(F.col("ent_type") == "date", "SKIP_NON_LINKABLE").when(F.col("confidence") >= 0.2, "REJECT_LINKABLE").otherwise("FILTERED_OUT")
    return m.select("mention_id", "run_id", F.concat_ws(":", F.col("start_offset") % 7, "surface").alias("span_key"), "surface", status.alias("status"), "confidence")


D_SQL = M_SQL + (
    ", decisions AS (SELECT mention_id, run_id, concat_ws(':', start_offset % 7, surface) AS span_key, surface, CASE WHEN confidence >= 0.7e0 THEN 'ACCEPT_LINKABLE' WHEN ent_type = 'date' THEN 'SKIP_NON_LINKABLE' "
    "WHEN confidence >= 0.2e0 THEN 'REJECT_LINKABLE' ELSE 'FILTERED_OUT' END AS status, confidence FROM mentions)"
)


def candidates(spark, d):
    """Up to three parts whose key lies next to the mention's part."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("cand_key"), F.col("p_name").alias("label"), F.col("p_type").alias("description"), F.round(F.col("p_retailprice") % 100 / 100, 4).alias("score"))
    near = mentions(spark, d).select("mention_id", "run_id", "surface", "ent_type", "start_offset", F.explode(F.array("part", F.col("part") + 1, F.col("part") + 2)).alias("cand_key"))
    return near.join(p, "cand_key").withColumn("compatible", F.col("cand_key") % 5 != 0).withColumn("source", F.when(F.col("cand_key") % 3 == 0, "wikidata").when(F.col("cand_key") % 3 == 1, "viaf").otherwise("geonames"))


C_SQL = M_SQL + (
    ", p AS (SELECT p_partkey AS cand_key, p_name AS label, p_type AS description, round(p_retailprice % 100 / 100, 4) AS score FROM part), near AS (SELECT mention_id, run_id, surface, ent_type, start_offset, unnest([part, part + 1, part + 2]) AS cand_key FROM mentions), "
    "candidates AS (SELECT *, cand_key % 5 <> 0 AS compatible, CASE cand_key % 3 WHEN 0 THEN 'wikidata' WHEN 1 THEN 'viaf' ELSE 'geonames' END AS source FROM near JOIN p USING (cand_key))"
)

RUN = 7
register("S1_get_run", lambda s, d: S.scan(runs(s, d), {"run_id": RUN}, limit=1), f"WITH {R_SQL} SELECT * FROM runs WHERE run_id = {RUN} LIMIT 1")
register("S2_list_events", lambda s, d: S.scan(events(s, d), {"run_id": RUN}, [F.col("id")]), f"WITH {E_SQL} SELECT * FROM ev WHERE run_id = {RUN} ORDER BY id")
register("S3_list_chunks", lambda s, d: S.scan(events(s, d), {"stage": "view"}, [F.col("id")], 25), f"WITH {E_SQL} SELECT * FROM ev WHERE stage = 'view' ORDER BY id LIMIT 25")
register("S4_list_mentions", lambda s, d: S.scan(mentions(s, d), {"ent_type": "person"}, [F.col("start_offset").asc(), F.col("confidence").desc(), F.col("mention_id")], 50), f"WITH {M_SQL} SELECT * FROM mentions WHERE ent_type = 'person' ORDER BY start_offset, confidence DESC, mention_id LIMIT 50")
register("S5_list_evidence_spans", lambda s, d: S.scan(mentions(s, d), {"ent_type": "place", "method": "rule:trigger", "surface": None}, [F.col("created_at"), F.col("mention_id")]), f"WITH {M_SQL} SELECT * FROM mentions WHERE ent_type = 'place' AND method = 'rule:trigger' ORDER BY created_at, mention_id")
register("S6_list_decisions", lambda s, d: S.scan(decisions(s, d), {"status": "ACCEPT_LINKABLE"}, [F.col("mention_id")], 100), f"WITH {D_SQL} SELECT * FROM decisions WHERE status = 'ACCEPT_LINKABLE' ORDER BY mention_id LIMIT 100")
register("S7_list_attempts", lambda s, d: S.scan(candidates(s, d), {"run_id": RUN}, [F.col("mention_id"), F.col("cand_key")]), f"WITH {C_SQL} SELECT * FROM candidates WHERE run_id = {RUN} ORDER BY mention_id, cand_key")
register("S9_latest_report", lambda s, d: S.first_by_key(mentions(s, d), ["run_id", "ent_type"], [F.col("created_at").desc(), F.col("mention_id").desc()]).select("run_id", "ent_type", "mention_id"), f"WITH {M_SQL} SELECT run_id, ent_type, mention_id FROM mentions QUALIFY row_number() OVER (PARTITION BY run_id, ent_type ORDER BY created_at DESC, mention_id DESC) = 1")
register("S10_tile_audit", lambda s, d: S.scan(mentions(s, d).select("run_id", "start_offset", "end_offset"), {"run_id": RUN}, [F.col("start_offset"), F.col("end_offset")]), f"WITH {M_SQL} SELECT run_id, start_offset, end_offset FROM mentions WHERE run_id = {RUN} ORDER BY start_offset, end_offset")
register("S11_ocr_attempts", lambda s, d: S.scan(events(s, d), {"event": "END"}, [F.col("id")], 200), f"WITH {E_SQL} SELECT * FROM ev WHERE event = 'END' ORDER BY id LIMIT 200")
register("S12_benchmark_references", lambda s, d: read(s, d, "benchmark").orderBy("item_id"), "SELECT * FROM benchmark ORDER BY item_id")
register("S13_backend_results", lambda s, d: S.scan(candidates(s, d), {"source": "viaf"}, [F.col("mention_id"), F.col("cand_key")], 100), f"WITH {C_SQL} SELECT * FROM candidates WHERE source = 'viaf' ORDER BY mention_id, cand_key LIMIT 100")
view = lambda name: f"(SELECT to_json({name}) AS row FROM {name})"
register("S14_table_view", lambda s, d: S.table_view(read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")), "SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::VARCHAR AS row FROM nation")
register("S15_S21_table_views", lambda s, d: S.table_view(S.scan(decisions(s, d).select("mention_id", "run_id", "span_key", "status"), {"run_id": RUN})), f"WITH {D_SQL} SELECT json_object('mention_id', mention_id, 'run_id', run_id, 'span_key', span_key, 'status', status)::VARCHAR AS row FROM decisions WHERE run_id = {RUN}")
register("S22_create_runs", lambda s, d: read(s, d, "documents").select(F.sha2(F.concat_ws("|", "source", "doc_id"), 256).alias("run_id"), F.col("source").alias("asset_ref"), F.lit("RUNNING").alias("status"), F.lit("RECEIVED").alias("current_stage")), "SELECT sha256(concat_ws('|', source, doc_id)) AS run_id, source AS asset_ref, 'RUNNING' AS status, 'RECEIVED' AS current_stage FROM documents")
register("S23_current_stage", lambda s, d: events(s, d).groupBy("run_id").agg(F.max_by("stage", F.struct("ts", "id")).alias("current_stage"), F.max("ts").alias("updated_at")), f"WITH {E_SQL} SELECT run_id, stage AS current_stage, max(ts) OVER (PARTITION BY run_id) AS updated_at FROM ev QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, id DESC) = 1")
register(
    "S24_partial_updates",
    lambda s, d: S.last_values(events(s, d).select("run_id", "id", F.when(F.col("event") == "END", F.col("stage")).alias("ended"), F.when(F.col("id") % 5 == 0, F.col("value")).alias("value")), "run_id", ["ended", "value"], "id"),
    f"WITH {E_SQL} SELECT run_id, max_by(stage, id) FILTER (event = 'END') AS ended, max_by(value, id) FILTER (id % 5 = 0) AS value FROM ev GROUP BY run_id",
)
register("S26_insert_mentions_defaults", lambda s, d: mentions(s, d).select("mention_id", F.coalesce(F.nullif("ent_type", F.lit("date")), F.lit("unknown")).alias("ent_type"), F.coalesce(F.nullif("method", F.lit("rule:capital")), F.lit("rule:unknown")).alias("method")), f"WITH {M_SQL} SELECT mention_id, coalesce(nullif(ent_type, 'date'), 'unknown') AS ent_type, coalesce(nullif(method, 'rule:capital'), 'rule:unknown') AS method FROM mentions")
register("S28_replace_decisions", lambda s, d: S.first_by_key(decisions(s, d), ["run_id", "span_key"], [F.col("mention_id").desc()]), f"WITH {D_SQL} SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY run_id, span_key ORDER BY mention_id DESC) = 1")
entity = lambda s, d: mentions(s, d).select(F.col("surface").alias("entity_id"), F.col("created_at"), F.col("created_at").alias("updated_at"), F.col("mention_id").alias("seq"), "ent_type", "confidence")
register("S35_upsert_entities", lambda s, d: S.upsert(entity(s, d), "entity_id", "created_at", "updated_at", "seq"), f"WITH {M_SQL} SELECT surface AS entity_id, min(created_at) OVER (PARTITION BY surface) AS created_at, created_at AS updated_at, mention_id AS seq, ent_type, confidence FROM mentions QUALIFY row_number() OVER (PARTITION BY surface ORDER BY created_at DESC, mention_id DESC) = 1")
register("S36_upsert_evidence", lambda s, d: mentions(s, d).select(F.sha2(F.concat_ws("|", "run_id", "surface", "start_offset"), 256).alias("span_id"), "mention_id", "end_offset").groupBy("span_id").agg(F.max_by("end_offset", F.struct("mention_id", "end_offset")).alias("end_offset")), f"WITH {M_SQL} SELECT sha256(concat_ws('|', run_id, surface, start_offset)) AS span_id, max_by(end_offset, mention_id * 10000 + end_offset) AS end_offset FROM mentions GROUP BY 1")
register("S37_upsert_links", lambda s, d: S.first_by_key(candidates(s, d).select("mention_id", "cand_key", "score"), ["mention_id"], [F.col("score").desc(), F.col("cand_key")]), f"WITH {C_SQL} SELECT mention_id, cand_key, score FROM candidates QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key) = 1")
register("S38_replace_aliases", lambda s, d: S.first_by_key(read(s, d, "customer").select(F.col("c_nationkey").alias("entity_id"), F.lower("c_mktsegment").alias("alias"), F.col("c_custkey").alias("pos")), ["entity_id", "alias"], [F.col("pos")]), "SELECT c_nationkey AS entity_id, lower(c_mktsegment) AS alias, min(c_custkey) AS pos FROM customer GROUP BY 1, 2")
register("S39_replace_assertions", lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("entity_id"), F.lit("tpch").alias("source_name"), F.col("c_mktsegment").alias("property_value")).dropDuplicates(), "SELECT DISTINCT c_nationkey AS entity_id, 'tpch' AS source_name, c_mktsegment AS property_value FROM customer")
register("S40_clear_analysis", lambda s, d: S.without(candidates(s, d), mentions(s, d).where("ent_type <> 'date'"), "mention_id").groupBy("run_id").agg(F.count("*").alias("left_over")), f"WITH {C_SQL} SELECT run_id, count(*) AS left_over FROM candidates WHERE mention_id NOT IN (SELECT mention_id FROM mentions WHERE ent_type <> 'date') GROUP BY run_id")
register("S41_S42_clear_links", lambda s, d: S.without(mentions(s, d).select("mention_id", "run_id"), read(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")), "run_id"), f"WITH {M_SQL} SELECT mention_id, run_id FROM mentions WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
cache = lambda s, d: events(s, d).groupBy(F.col("run_id").alias("cache_key")).agg(F.max("ts").alias("created_at"), F.sum(F.when(F.col("stage") == "purchase", 1).otherwise(0)).alias("n_results"))
CACHE_SQL = f"{E_SQL}, cache AS (SELECT run_id AS cache_key, max(ts) AS created_at, sum(CASE WHEN stage = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS n_results FROM ev GROUP BY run_id), latest AS (SELECT max(ts) AS now FROM events)"


def cache_states(s, d):
    wanted = read(s, d, "customer").select(F.col("c_custkey").alias("cache_key"))
    joined = wanted.crossJoin(F.broadcast(read(s, d, "events").agg(F.max("ts").alias("now"))))  # one row
    return S.cache_status(joined, cache(s, d), F.col("now"), 6).select("cache_key", "status")


register("S46_S47_cache_status", cache_states, f"WITH {CACHE_SQL} SELECT c_custkey AS cache_key, CASE WHEN created_at IS NULL THEN 'miss' WHEN n_results > 0 THEN 'hit' WHEN created_at < now - INTERVAL 6 HOUR THEN 'expired' ELSE 'empty-hit' END AS status FROM customer LEFT JOIN cache ON c_custkey = cache_key, latest")
register("S48_cache_put", lambda s, d: cache(s, d).where("n_results > 0"), f"WITH {CACHE_SQL} SELECT cache_key, created_at, n_results FROM cache WHERE n_results > 0")
register("S57_vector_upsert", lambda s, d: S.first_by_key(read(s, d, "embeddings").select((F.col("vec_id") % 100).alias("id"), "vec_id", "label"), ["id"], [F.col("vec_id").desc()]), "SELECT vec_id % 100 AS id, vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY vec_id % 100 ORDER BY vec_id DESC) = 1")
register("S58_delete_run_vectors", lambda s, d: read(s, d, "embeddings").where("label <> 3").select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE label <> 3")
register("S59_expire_tasks", lambda s, d: read(s, d, "orders").where(F.col("o_orderdate") >= F.to_timestamp(F.lit("1996-01-01"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")

# ---- joins -------------------------------------------------------------------------
register("J2_report_top_candidates", lambda s, d: candidates(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.col("score").desc(), F.col("cand_key")))).where("rank <= 2").select("mention_id", "rank", "label", "score"), f"WITH {C_SQL} SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key) AS rank, label, score FROM candidates QUALIFY rank <= 2")
register("J3_attempts_of_run", lambda s, d: candidates(s, d).select("mention_id", "cand_key").join(decisions(s, d).select("mention_id", "surface", "status"), "mention_id").groupBy("status").agg(F.count("*").alias("attempts"), F.countDistinct("surface").alias("surfaces")), f"WITH {D_SQL}, near AS (SELECT mention_id, unnest([part, part + 1, part + 2]) AS cand_key FROM mentions) SELECT status, count(*) AS attempts, count(DISTINCT surface) AS surfaces FROM near JOIN part ON p_partkey = cand_key JOIN decisions USING (mention_id) GROUP BY status")


def chunk_of_span(s, d):
    """The first chunk that holds the span, else the first that overlaps it; chunks are 100 places long, spans at most 50."""
    m = mentions(s, d).select("mention_id", "start_offset", "end_offset")
    # A span meets the chunk of its start and the next one: an equi-join on the chunk number instead of a range join.
    near = m.withColumn("idx", F.explode(F.array(F.floor(F.col("start_offset") / 100), F.floor(F.col("start_offset") / 100) + 1)))
    inside = (F.col("start_offset") >= F.col("idx") * 100) & (F.col("end_offset") <= F.col("idx") * 100 + 100)
    over = (F.col("start_offset") < F.col("idx") * 100 + 100) & (F.col("end_offset") > F.col("idx") * 100)
    return near.where(inside | over).groupBy("mention_id").agg(F.min_by("idx", F.struct(F.when(inside, 0).otherwise(1), F.col("idx"))).alias("chunk_id"))


register("J4_chunk_of_span", chunk_of_span, f"WITH {M_SQL}, chunk AS (SELECT unnest(range(0, 12)) AS idx) SELECT mention_id, idx AS chunk_id FROM mentions JOIN chunk ON start_offset < idx * 100 + 100 AND end_offset > idx * 100 OR (start_offset >= idx * 100 AND end_offset <= idx * 100 + 100) QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY CASE WHEN start_offset >= idx * 100 AND end_offset <= idx * 100 + 100 THEN 0 ELSE 1 END, idx) = 1")
keys = ["run_id", "start_offset", "end_offset", "ent_type", "surface"]
register("J5_composite_key_join", lambda s, d: mentions(s, d).where("method = 'rule:trigger'").select("confidence", *keys).join(mentions(s, d).select("mention_id", *keys), keys), f"WITH {M_SQL} SELECT a.confidence, b.mention_id, a.run_id, a.start_offset, a.end_offset, a.ent_type, a.surface FROM mentions a JOIN mentions b ON a.run_id = b.run_id AND a.start_offset = b.start_offset AND a.end_offset = b.end_offset AND a.ent_type = b.ent_type AND a.surface = b.surface WHERE a.method = 'rule:trigger'")
register("J8_aliases_by_entity", lambda s, d: read(s, d, "customer").join(read(s, d, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").groupBy(F.col("c_nationkey").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("aliases")), "SELECT c_nationkey AS entity_id, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS aliases FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
register("J9_assertions_by_entity", lambda s, d: read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("entity_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "s_name", "s_suppkey"))), "; ").alias("facts")), "SELECT s_nationkey AS entity_id, string_agg(concat_ws('=', s_name, s_suppkey), '; ' ORDER BY concat_ws('=', s_name, s_suppkey)) AS facts FROM supplier GROUP BY 1")
register("J10_X10_X11_not_indexed", lambda s, d: runs(s, d).select("run_id").join(events(s, d).select("run_id").distinct(), "run_id", "left_anti").select("run_id"), f"WITH {R_SQL}, {E_SQL} SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM ev)")
register("J14_filter_by_classes", lambda s, d: read(s, d, "lineitem").join(read(s, d, "part").where("p_size <= 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)")
register("J18_entity_hits", lambda s, d: candidates(s, d).groupBy("cand_key").agg(F.max("score").alias("best"), F.count("*").alias("hits")), f"WITH {C_SQL} SELECT cand_key, max(score) AS best, count(*) AS hits FROM candidates GROUP BY 1")

# ---- aggregations ---------------------------------------------------------------------
register("A1_count_chunks", lambda s, d: events(s, d).groupBy("run_id").agg(F.count("*").alias("n")), f"WITH {E_SQL} SELECT run_id, count(*) AS n FROM ev GROUP BY 1")
register("A2_count_mentions", lambda s, d: mentions(s, d).groupBy("run_id").agg(F.count("*").alias("n")), f"WITH {M_SQL} SELECT run_id, count(*) AS n FROM mentions GROUP BY 1")
register("A3_count_decisions", lambda s, d: decisions(s, d).groupBy("run_id", "status").agg(F.count("*").alias("n")), f"WITH {D_SQL} SELECT run_id, status, count(*) AS n FROM decisions GROUP BY 1, 2")
register("A8_status_type_cube", lambda s, d: decisions(s, d).join(mentions(s, d).select("mention_id", "ent_type"), "mention_id").cube("status", "ent_type").agg(F.count("*").alias("n")), f"WITH {D_SQL} SELECT status, ent_type, count(*) AS n FROM decisions JOIN mentions USING (mention_id) GROUP BY CUBE (status, ent_type)")


def audit(s, d):
    """AUDIT_1 valid statuses and surfaces, AUDIT_2 attempts without decision, AUDIT_3 totals and unique span keys."""
    dec = decisions(s, d)
    orphans = candidates(s, d).select("mention_id").join(dec, "mention_id", "left_anti").agg(F.count("*").alias("orphans"))
    valid = F.col("status").isin("ACCEPT_LINKABLE", "REJECT_LINKABLE", "SKIP_NON_LINKABLE", "FILTERED_OUT") & (F.col("surface") != "")
    totals = dec.agg(F.bool_and(valid).alias("valid"), F.count("*").alias("total"), F.count_if(F.col("status") == "ACCEPT_LINKABLE").alias("accepted"), F.countDistinct("run_id", "span_key").alias("spans"))
    return totals.crossJoin(orphans)  # one row each


register("A8_audit_gates", audit, f"WITH {D_SQL} SELECT bool_and(status IN ('ACCEPT_LINKABLE', 'REJECT_LINKABLE', 'SKIP_NON_LINKABLE', 'FILTERED_OUT') AND surface <> '') AS valid, count(*) AS total, count(*) FILTER (status = 'ACCEPT_LINKABLE') AS accepted, count(DISTINCT (run_id, span_key)) AS spans, 0::BIGINT AS orphans FROM decisions")
register("A7_extraction_report", lambda s, d: mentions(s, d).join(decisions(s, d).select("mention_id", "status"), "mention_id").withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.col("confidence").desc(), F.col("mention_id")))).where("place <= 10").select("status", "place", "mention_id", "method", "confidence"), f"WITH {D_SQL} SELECT status, row_number() OVER (PARTITION BY status ORDER BY m.confidence DESC, mention_id) AS place, mention_id, method, m.confidence FROM decisions JOIN mentions m USING (mention_id) QUALIFY place <= 10")
register("A9_result_counts", lambda s, d: candidates(s, d).groupBy("ent_type", "source").agg(F.count("*").alias("n"), F.count_if(~F.col("compatible")).alias("mismatches")), f"WITH {C_SQL} SELECT ent_type, source, count(*) AS n, count(*) FILTER (NOT compatible) AS mismatches FROM candidates GROUP BY 1, 2")
register("A10_pivot_status", lambda s, d: decisions(s, d).join(mentions(s, d).select("mention_id", "ent_type"), "mention_id").groupBy("ent_type").pivot("status", ["ACCEPT_LINKABLE", "REJECT_LINKABLE"]).count().na.fill(0), f"WITH {D_SQL} SELECT ent_type, count(*) FILTER (status = 'ACCEPT_LINKABLE') AS ACCEPT_LINKABLE, count(*) FILTER (status = 'REJECT_LINKABLE') AS REJECT_LINKABLE FROM decisions JOIN mentions USING (mention_id) GROUP BY 1")
register("A11_persist_unresolved", lambda s, d: mentions(s, d).groupBy("ent_type").agg(F.count("*").alias("n"), F.round(F.sum(F.least("confidence", F.lit(0.35))), 2).alias("capped")), f"WITH {M_SQL} SELECT ent_type, count(*) AS n, round(sum(least(confidence, 0.35e0)), 2) AS capped FROM mentions GROUP BY 1")
register("A14_A16_merge_confidence", lambda s, d: mentions(s, d).groupBy("run_id").agg(F.round(F.least(F.greatest(F.sum(F.col("confidence") * (F.col("end_offset") - F.col("start_offset"))) / F.sum(F.col("end_offset") - F.col("start_offset")), F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"), F.round(F.least(F.avg("confidence"), F.lit(1.0)), 6).alias("mean")), f"WITH {M_SQL} SELECT run_id, round(least(greatest(sum(confidence * (end_offset - start_offset)) / sum(end_offset - start_offset), 0e0), 1e0), 6) AS confidence, round(least(avg(confidence), 1e0), 6) AS mean FROM mentions GROUP BY 1")
register("A15_weighted_vote", lambda s, d: mentions(s, d).groupBy("run_id", "surface").agg(F.sum(F.greatest("confidence", F.lit(0.05))).alias("w"), F.min("mention_id").alias("first")).groupBy("run_id").agg(F.max_by("surface", F.struct(F.round("w", 6), -F.col("first"))).alias("hint")), f"WITH {M_SQL}, v AS (SELECT run_id, surface, round(sum(greatest(confidence, 0.05e0)), 6) AS w, min(mention_id) AS first_seen FROM mentions GROUP BY 1, 2) SELECT run_id, surface AS hint FROM v QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY w DESC, first_seen) = 1")
register("A20_best_backend", lambda s, d: candidates(s, d).groupBy("mention_id").agg(F.max_by("source", F.struct("score", -F.col("cand_key"))).alias("backend")).groupBy("backend").agg(F.count("*").alias("n")), f"WITH {C_SQL}, b AS (SELECT mention_id, source AS backend FROM candidates QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key) = 1) SELECT backend, count(*) AS n FROM b GROUP BY 1")
register("A21_entity_documents", lambda s, d: mentions(s, d).groupBy(F.col("surface").alias("entity_id")).agg(F.max("confidence").alias("confidence"), F.array_join(F.slice(F.array_sort(F.collect_set("part")), 1, 12), ",").alias("parts")), f"WITH {M_SQL} SELECT surface AS entity_id, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(part)))[1:12], ',') AS parts FROM mentions GROUP BY 1")
register("A22_A23_trace_snapshot", lambda s, d: events(s, d).groupBy("run_id").agg(F.count("*").alias("events"), F.max_by("stage", F.when(F.col("event") == "END", F.col("id"))).alias("last_end")), f"WITH {E_SQL} SELECT run_id, count(*) AS events, max_by(stage, id) FILTER (event = 'END') AS last_end FROM ev GROUP BY 1")
register("A5_class_counts", lambda s, d: read(s, d, "lineitem").join(read(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left").groupBy(F.coalesce("p_brand", F.concat(F.lit("cls_"), F.col("l_partkey") % 7)).alias("name")).agg(F.count("*").alias("n")), "SELECT coalesce(p_brand, concat('cls_', l_partkey % 7)) AS name, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 2 = 0 GROUP BY 1")
register("A24_A25_evidence_tags", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", F.regexp_count(F.col("text"), F.lit("[A-Z][a-z]+")).alias("tags")), "SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Z][a-z]+'))::INT AS tags FROM conversations")


# ---- visits ------------------------------------------------------------------------------
def visits(s, d):
    return read(s, d, "events").select("ts", F.when(F.col("user_id") % 11 == 0, "").when(F.col("user_id") % 13 == 0, None).otherwise(F.concat(F.lit("C"), F.col("user_id") % 7)).alias("country"), F.col("user_id").alias("visitor_id"), (F.col("event_type") == "error").cast("int").alias("is_bot"), F.col("event_type").alias("action"))


V_SQL = "visits AS (SELECT ts, CASE WHEN user_id % 11 = 0 THEN '' WHEN user_id % 13 = 0 THEN NULL ELSE concat('C', user_id % 7) END AS country, user_id AS visitor_id, (event_type = 'error')::INT AS is_bot, event_type AS action FROM events)"
register("A4_visits_by_country", lambda s, d: visits(s, d).groupBy(F.coalesce(F.nullif("country", F.lit("")), F.lit("Unknown")).alias("country")).agg(F.count("*").alias("visits"), F.countDistinct("visitor_id").alias("visitors")), f"WITH {V_SQL} SELECT coalesce(nullif(country, ''), 'Unknown') AS country, count(*) AS visits, count(DISTINCT visitor_id) AS visitors FROM visits GROUP BY 1")
register("A4_visits_by_day", lambda s, d: visits(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("visits"), F.countDistinct("visitor_id").alias("visitors")).orderBy(F.col("day").desc()).limit(30), f"WITH {V_SQL} SELECT ts::DATE AS day, count(*) AS visits, count(DISTINCT visitor_id) AS visitors FROM visits GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
register("A4_visits_summary", lambda s, d: visits(s, d).agg(F.count("*").alias("total"), F.countDistinct("visitor_id").alias("visitors"), F.countDistinct(F.nullif("country", F.lit(""))).alias("countries"), F.sum(F.when(F.col("is_bot") == 1, 1).otherwise(0)).alias("bots"), F.sum(F.when(F.col("action") == "purchase", 1).otherwise(0)).alias("purchases")), f"WITH {V_SQL} SELECT count(*) AS total, count(DISTINCT visitor_id) AS visitors, count(DISTINCT nullif(country, '')) AS countries, sum(CASE WHEN is_bot = 1 THEN 1 ELSE 0 END)::BIGINT AS bots, sum(CASE WHEN action = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS purchases FROM visits")
register("A4_recent_visits", lambda s, d: visits(s, d).orderBy(F.col("ts").desc(), "visitor_id", "action").limit(100).select("ts", "visitor_id", "action"), f"WITH {V_SQL} SELECT ts, visitor_id, action FROM visits ORDER BY ts DESC, visitor_id, action LIMIT 100")

# ---- ranking ------------------------------------------------------------------------------
register("W1_best_pass", lambda s, d: mentions(s, d).groupBy("run_id").agg(F.min_by("mention_id", F.struct("ent_type", "confidence", "start_offset", "mention_id")).alias("best")), f"WITH {M_SQL} SELECT run_id, mention_id AS best FROM mentions QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ent_type, confidence, start_offset, mention_id) = 1")
register("W2_best_attempt", lambda s, d: S.best_attempt(mentions(s, d).withColumn("passed", F.col("confidence") >= 0.5), "run_id", "passed", "mention_id", ["mention_id", "passed"]), f"WITH {M_SQL} SELECT run_id, mention_id, confidence >= 0.5e0 AS passed FROM mentions QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY confidence >= 0.5e0 DESC, mention_id DESC) = 1")


def disambiguated(s, d):
    """linked, ambiguous or unresolved: only the best candidate counts, by tier threshold and margin."""
    by_score = Window.partitionBy("mention_id").orderBy(F.col("score").desc(), F.col("cand_key"))
    ranked = candidates(s, d).withColumn("rank", F.row_number().over(by_score)).withColumn("second", F.lead("score").over(by_score)).where("rank = 1")
    status = F.when(~F.col("compatible"), "unresolved").when(F.col("score") < 0.85, "unresolved").when(F.round(F.col("score") - F.col("second"), 6) < 0.15, "ambiguous").otherwise("linked")
    return ranked.select("mention_id", "cand_key", "score", status.alias("status"))


register("W4_disambiguate", disambiguated, f"WITH {C_SQL} SELECT mention_id, cand_key, score, CASE WHEN NOT compatible THEN 'unresolved' WHEN score < 0.85e0 THEN 'unresolved' WHEN round(score - second, 6) < 0.15e0 THEN 'ambiguous' ELSE 'linked' END AS status FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rank FROM candidates WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, cand_key)) WHERE rank = 1")
register("W16_backend_ranking", lambda s, d: candidates(s, d).groupBy("source").agg(F.round(F.avg("score"), 6).alias("quality")).withColumn("place", F.row_number().over(Window.orderBy(F.col("quality").desc(), F.col("source")))), f"WITH {C_SQL} SELECT source, quality, row_number() OVER (ORDER BY quality DESC, source) AS place FROM (SELECT source, round(avg(score), 6) AS quality FROM candidates GROUP BY 1)")
register("W18_linking_report", lambda s, d: disambiguated(s, d).withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.col("score").desc(), F.col("mention_id")))).where("place <= 6").select("status", "place", "mention_id"), f"WITH {C_SQL}, dis AS (SELECT mention_id, score, CASE WHEN NOT compatible THEN 'unresolved' WHEN score < 0.85e0 THEN 'unresolved' WHEN round(score - second, 6) < 0.15e0 THEN 'ambiguous' ELSE 'linked' END AS status FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rank FROM candidates WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, cand_key)) WHERE rank = 1) SELECT status, row_number() OVER (PARTITION BY status ORDER BY score DESC, mention_id) AS place, mention_id FROM dis QUALIFY place <= 6")
register("W19_unused_variant", lambda s, d: candidates(s, d).where("source <> 'viaf'").groupBy("mention_id").agg(F.max_by("cand_key", F.struct("score", "cand_key")).alias("variant")), f"WITH {C_SQL} SELECT mention_id, cand_key AS variant FROM candidates WHERE source <> 'viaf' QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key DESC) = 1")
register("P35_degenerate_repeats", lambda s, d: mentions(s, d).select("mention_id", (F.row_number().over(Window.partitionBy("surface", "method").orderBy("mention_id")) > 1).alias("repeated")), f"WITH {M_SQL} SELECT mention_id, row_number() OVER (PARTITION BY surface, method ORDER BY mention_id) > 1 AS repeated FROM mentions")
register("X5_union_of_sources", lambda s, d: candidates(s, d).withColumn("place", F.row_number().over(Window.partitionBy("mention_id", "source").orderBy("cand_key"))).where("place <= 1").groupBy("source").agg(F.count("*").alias("n")), f"WITH {C_SQL} SELECT source, count(*) AS n FROM (SELECT source FROM candidates QUALIFY row_number() OVER (PARTITION BY mention_id, source ORDER BY cand_key) <= 1) GROUP BY 1")
register("X6_rejected_minus_accepted", lambda s, d: decisions(s, d).where("status = 'REJECT_LINKABLE'").select("run_id", F.lower("surface").alias("surface")).distinct().join(decisions(s, d).where("status = 'ACCEPT_LINKABLE'").select("run_id", F.lower("surface").alias("surface")), ["run_id", "surface"], "left_anti"), f"WITH {D_SQL} SELECT DISTINCT run_id, lower(surface) AS surface FROM decisions WHERE status = 'REJECT_LINKABLE' EXCEPT SELECT run_id, lower(surface) FROM decisions WHERE status = 'ACCEPT_LINKABLE'")
register("X3_X4_merge_candidates", lambda s, d: candidates(s, d).groupBy(F.concat_ws(":", "source", "cand_key").alias("identity")).agg(F.max("score").alias("score"), F.min("label").alias("label")), f"WITH {C_SQL} SELECT concat_ws(':', source, cand_key) AS identity, max(score) AS score, min(label) AS label FROM candidates GROUP BY 1")
