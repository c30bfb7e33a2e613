"""Views, links and searches over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators.retrieval import search
from palimpsest.plans.retrieval import vectors
from palimpsest.plans.store import C_SQL, D_SQL, M_SQL, candidates, decisions, mentions, read
from palimpsest.plans.text_quality import DOCS, documents
from palimpsest.registry import register

register("S8_list_quality_reports", lambda s, d: decisions(s, d).select("mention_id", (F.col("status") == "ACCEPT_LINKABLE").alias("ner_allowed")), f"WITH {D_SQL} SELECT mention_id, status = 'ACCEPT_LINKABLE' AS ner_allowed FROM decisions")
register("S18_candidates_view", lambda s, d: candidates(s, d).select("mention_id", "cand_key", "surface", "label", "score"), f"WITH {C_SQL} SELECT mention_id, cand_key, surface, label, score FROM candidates")
register("S20_attempts_view", lambda s, d: candidates(s, d).select("mention_id", "cand_key").join(decisions(s, d).select("mention_id", "run_id", "status"), "mention_id"), f"WITH {C_SQL}, dec AS (SELECT mention_id, run_id, CASE WHEN confidence >= 0.7e0 THEN 'ACCEPT_LINKABLE' WHEN ent_type = 'date' THEN 'SKIP_NON_LINKABLE' WHEN confidence >= 0.2e0 THEN 'REJECT_LINKABLE' ELSE 'FILTERED_OUT' END AS status FROM mentions) SELECT mention_id, cand_key, dec.run_id, status FROM candidates JOIN dec USING (mention_id)")
register("S27_insert_candidates", lambda s, d: candidates(s, d).where((F.col("label") != "") & F.col("mention_id").isNotNull()).select("mention_id", F.to_json(F.struct("source", "cand_key")).alias("meta")), f"WITH {C_SQL} SELECT mention_id, json_object('source', source, 'cand_key', cand_key)::VARCHAR AS meta FROM candidates WHERE label <> '' AND mention_id IS NOT NULL")
register(
    "J1_mention_links",
    lambda s, d: candidates(s, d).select("mention_id", "cand_key", "score", "source").join(mentions(s, d).select("mention_id", "run_id", "surface", "start_offset", "part"), "mention_id").join(read(s, d, "supplier").select(F.col("s_suppkey").alias("cand_key"), F.col("s_name").alias("entity")), "cand_key", "left").join(read(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("evidence")), "run_id", "left"),
    f"WITH {C_SQL} SELECT c.mention_id, c.cand_key, c.score, c.source, m.run_id, m.surface, m.start_offset, m.part, s_name AS entity, o_orderpriority AS evidence FROM candidates c JOIN mentions m USING (mention_id) LEFT JOIN supplier ON s_suppkey = c.cand_key LEFT JOIN orders ON o_orderkey = m.run_id AND o_orderstatus = 'O'",
)


def comparison_runs(s, d):
    """Per run and backend: its labels in reading order, the mean score, and what went wrong instead of a row."""
    rows = candidates(s, d).withColumn("error", F.when(F.col("score") < 0.05, F.concat(F.lit("no text for "), F.col("mention_id").cast("string"))))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("start_offset", "mention_id", "cand_key", "label")))), lambda x: x["label"]), "\n")
    return rows.groupBy("run_id", "source").agg(told.alias("text"), F.round(F.avg(F.when(F.col("error").isNull(), F.col("score"))), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))


register("A19_comparison_runs", comparison_runs, f"WITH {C_SQL}, e AS (SELECT *, CASE WHEN score < 0.05e0 THEN concat('no text for ', mention_id) END AS error FROM candidates) SELECT run_id, source, coalesce(string_agg(label, chr(10) ORDER BY start_offset, mention_id, cand_key) FILTER (error IS NULL), '') AS text, round(avg(score) FILTER (error IS NULL), 6) AS confidence, coalesce(string_agg(error, '; ' ORDER BY error), '') AS errors FROM e GROUP BY 1, 2")
register("W8_ordered_regions", lambda s, d: mentions(s, d).select("mention_id", F.row_number().over(Window.partitionBy("run_id").orderBy(F.when(F.col("start_offset") > 200, F.col("start_offset")).asc_nulls_last(), F.col("mention_id"))).alias("place")), f"WITH {M_SQL} SELECT mention_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN start_offset > 200 THEN start_offset END ASC NULLS LAST, mention_id) AS place FROM mentions")
register(
    "W21_top_candidates",
    lambda s, d: candidates(s, d).withColumn("place", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.col("score").desc(), "cand_key"))).where("place <= 3").select("mention_id", "place", "cand_key", "label", "source", F.round("score", 4).alias("score")),
    f"WITH {C_SQL} SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key) AS place, cand_key, label, source, round(score, 4) AS score FROM candidates QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, cand_key) <= 3",
)
register("T116_score_breakdown", lambda s, d: candidates(s, d).select("mention_id", "cand_key", F.col("score").alias("label"), F.round(1 - F.col("score"), 4).alias("context"), F.col("compatible").alias("type")), f"WITH {C_SQL} SELECT mention_id, cand_key, score AS label, round(1 - score, 4) AS context, compatible AS type FROM candidates")
register("T117_confidence_text", lambda s, d: candidates(s, d).select("mention_id", "cand_key", F.coalesce(F.format_string("%.4f", "score"), F.lit("")).alias("shown")), f"WITH {C_SQL} SELECT mention_id, cand_key, printf('%.4f', score) AS shown FROM candidates")


def top_of_each(s, d, k: int, where: str = "true"):
    """The k rows most like each vector whose id is divisible by 50."""
    queries = vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search(vectors(s, d).where(where), queries, k)


def q_top(k: int, where: str = "true") -> str:
    cos = "SELECT query_id, vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS score FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"
    return f"SELECT * FROM ({cos} WHERE {where}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"


register("V1_retrieve_chunks", lambda s, d: top_of_each(s, d, 5), q_top(5))
register("V2_retrieve_entities", lambda s, d: top_of_each(s, d, 4, "label IN (1, 2, 3)"), q_top(4, "label IN (1, 2, 3)"))
register("V7_retrieve_debug", lambda s, d: top_of_each(s, d, 20).withColumn("distance", F.round(1 - F.col("score"), 4)), f"SELECT *, round(1 - score, 4) AS distance FROM ({q_top(20)})")

SIGNATURE = r"regexp_replace(regexp_replace(lower(text), '^[^\p{L}\p{Nl}\p{No}]+', ''), '[^\p{L}\p{N}]+', ' ', 'g')"
register(
    "T58_repeat_signature",
    lambda s, d: documents(s, d).select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"^[^\p{L}\p{Nl}\p{No}]+", ""), r"[^\p{L}\p{N}]+", " ")).alias("signature")),
    f"WITH {DOCS} SELECT doc_id, trim({SIGNATURE}) AS signature FROM docs",
)
