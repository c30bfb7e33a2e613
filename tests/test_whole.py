"""Queries over all rows reach all rows."""

from pyspark.sql import functions as F

from palimpsest import registry


def test_rows_beyond_the_first_runs(spark, sf):
    q = registry.queries()
    mentions = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in ("S8_list_quality_reports", "S43_evidence_jsonl", "W8_ordered_regions"):
        assert q[name](spark, sf).count() == mentions


def test_each_query_vector_has_its_neighbours(spark, sf):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    got = registry.queries()["V1_retrieve_chunks"](spark, sf).collect()
    assert {r["query_id"] for r in got} == ids and len(got) == 5 * len(ids)


def test_signatures_are_whole(spark, sf):
    got = {r["doc_id"]: r["signature"] for r in registry.queries()["T58_repeat_signature"](spark, sf).collect()}
    assert max(map(len, got.values())) > 1000 and any(" " in x for x in got.values())


def test_equal_mentions_come_in_one_order(spark, sf, tmp_path):
    lines, parts = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet")
    one = lines.limit(1).withColumns({"l_orderkey": F.lit(1).cast("long"), "l_discount": F.lit(0.09)})
    both = [one.withColumn("l_suppkey", F.lit(k).cast("long")) for k in (6, 38)]
    got = []
    for name, (a, b) in (("up", both), ("down", both[::-1])):
        a.unionByName(b).coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        parts.write.parquet(f"{tmp_path}/{name}/part.parquet")
        got += registry.queries()["R7_consolidated_report"](spark, f"{tmp_path}/{name}").collect()
    assert [r["report"].split("\n")[1] for r in got] == ["top: S38,S6"] * 2
