"""Appends, spans, suggestions and annotation records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.plans.geometry import B_SQL, boxes
from palimpsest.plans.store import E_SQL, M_SQL, events, mentions
from palimpsest.registry import register



def by_model(s, d):
    """Three models' annotations in fixed order, numbered over the page."""
    model = F.when(F.col("name").isin("MainZone", "MarginTextZone", "NumberingZone"), 0).when(F.col("name") == "Main script black", 1).otherwise(2)
    return boxes(s, d).select("page_id", "box_id", model.alias("model")).withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("model", "box_id")))


register("S53_models_in_order", by_model, f"WITH {B_SQL} SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY model, box_id) AS pos FROM (SELECT page_id, box_id, CASE WHEN name IN ('MainZone', 'MarginTextZone', 'NumberingZone') THEN 0 WHEN name = 'Main script black' THEN 1 ELSE 2 END AS model FROM boxes)")
register("N18_N23_N24_suggestions", lambda s, d: boxes(s, d).select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "box_id")).alias("reading_order"), "x1", "y1", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")), f"WITH {B_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, box_id) AS reading_order, x1, y1, x2 - x1 AS width, y2 - y1 AS height FROM boxes")
register("T101_union_box", lambda s, d: boxes(s, d).where("name <> 'GraphicZone'").groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")), f"WITH {B_SQL} SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes WHERE name <> 'GraphicZone' GROUP BY 1")
register("M8_padded_boxes", lambda s, d: boxes(s, d).select("page_id", "box_id", F.greatest(F.lit(0), F.col("x1") - F.floor((F.col("x2") - F.col("x1")) * 0.04)).cast("int").alias("x1"), F.least(F.lit(520), F.col("x2") + F.floor((F.col("x2") - F.col("x1")) * 0.04)).cast("int").alias("x2")), f"WITH {B_SQL} SELECT page_id, box_id, greatest(0, x1 - floor((x2 - x1) * 0.04e0)::INT) AS x1, least(520, x2 + floor((x2 - x1) * 0.04e0)::INT) AS x2 FROM boxes")


def rotated(s, d):
    """Corner of each box turned by 5 degrees about the centre of a 600 x 400 page."""
    angle = 0.08726646259971647
    dx, dy = F.col("x1") - 300, F.col("y1") - 200
    return boxes(s, d).select("page_id", "box_id", F.round(300 + dx * F.cos(F.lit(angle)) - dy * F.sin(F.lit(angle)), 4).alias("x"), F.round(200 + dx * F.sin(F.lit(angle)) + dy * F.cos(F.lit(angle)), 4).alias("y"))


register("N26_N27_rotated_points", rotated, f"WITH {B_SQL} SELECT page_id, box_id, round(300 + (x1 - 300) * cos(0.08726646259971647e0) - (y1 - 200) * sin(0.08726646259971647e0), 4) AS x, round(200 + (x1 - 300) * sin(0.08726646259971647e0) + (y1 - 200) * cos(0.08726646259971647e0), 4) AS y FROM boxes")
