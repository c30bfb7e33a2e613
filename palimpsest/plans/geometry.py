"""Page geometry over boxes derived from ``lineitem`` and pages from ``orders``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import geometry as G
from palimpsest.plans.store import read
from palimpsest.registry import register

NAMES = ["Main script black", "MarginTextZone", "NumberingZone", "GraphicZone", "Music", "DropCapitalZone", "Embellished", "Table", "MainZone", "DefaultLine", "Page Number", "Diagram"]


def boxes(s, d, of_pages="true"):
    """About four boxes a page on a small canvas, so that many overlap; ``of_pages``: a condition on ``l_orderkey``.

    Dealt by page first: the window on single boxes and all later steps by page then share one shuffle.
    """
    x1, y1 = (F.col("l_partkey") * 7 % 300).cast("int"), (F.col("l_suppkey") * 13 % 300).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_partkey") % len(NAMES) + 1).cast("int"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").where(of_pages).repartition("l_orderkey").select(
        F.col("l_orderkey").alias("page_id"), ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")).alias("box_id"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity") * 4).cast("int").alias("x2"), (y1 + 10 + F.col("l_quantity") * 2).cast("int").alias("y2"), name.alias("name"),
        F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_quantity")).alias("k"),
    ).where("k = 1").drop("k")


B_SQL = (
    "boxes AS (SELECT page_id, box_id, x1, y1, x2, y2, name FROM (SELECT l_orderkey AS page_id, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS box_id, (l_partkey * 7 % 300)::INT AS x1, (l_suppkey * 13 % 300)::INT AS y1, "
    "((l_partkey * 7 % 300) + 20 + l_quantity * 4)::INT AS x2, ((l_suppkey * 13 % 300) + 10 + l_quantity * 2)::INT AS y2, "
    "[" + ", ".join(f"'{n}'" for n in NAMES) + f"][(l_partkey % {len(NAMES)} + 1)::INT] AS name, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS m FROM lineitem) WHERE k = 1)"
)


def pages(s, d):
    return read(s, d, "orders").select(F.col("o_orderkey").alias("page_id"), (F.lit(600) + F.col("o_custkey") % 900).cast("int").alias("width"), (F.lit(800) + F.col("o_orderkey") % 700).cast("int").alias("height"))


P_SQL = "pages AS (SELECT o_orderkey AS page_id, (600 + o_custkey % 900)::INT AS width, (800 + o_orderkey % 700)::INT AS height FROM orders)"
GRID_SQL = (
    f"{P_SQL}, cell AS (SELECT *, unnest([0, 0, 1, 1, 2, 2]) AS r, unnest([0, 1, 0, 1, 0, 1]) AS c, greatest(1, height // 3) AS th, greatest(1, width // 2) AS tw FROM pages), o AS (SELECT *, greatest(4, floor(th * 0.15e0)::INT) AS oy, greatest(4, floor(tw * 0.15e0)::INT) AS ox FROM cell), "
    "g AS (SELECT page_id, r, c, width, height, CASE WHEN c > 0 THEN greatest(0, c * tw - ox) ELSE c * tw END AS a, CASE WHEN r > 0 THEN greatest(0, r * th - oy) ELSE r * th END AS b, CASE WHEN c < 1 THEN least(width, c * tw + tw + ox) ELSE c * tw + tw END AS e, CASE WHEN r < 2 THEN least(height, r * th + th + oy) ELSE r * th + th END AS f FROM o) "
    "SELECT page_id, r, c, greatest(0, least(a, width - 1)) AS x1, greatest(0, least(b, height - 1)) AS y1, greatest(1, least(e, width)) AS x2, greatest(1, least(f, height)) AS y2 FROM g"
)
register("M9_make_grid", lambda s, d: G.grid(pages(s, d), 3, 2, 0.15), f"WITH {GRID_SQL}")
register("M12_expand_overlap", lambda s, d: G.expanded(boxes(s, d).select("page_id", "box_id", "x1", "y1", "x2", "y2"), 0.22, 500, 500), f"WITH {B_SQL}, e AS (SELECT *, greatest(4, floor((x2 - x1) * 0.22e0)::INT) AS dx, greatest(4, floor((y2 - y1) * 0.22e0)::INT) AS dy FROM boxes) SELECT page_id, box_id, greatest(0, least(x1 - dx, 499)) AS x1, greatest(0, least(y1 - dy, 499)) AS y1, greatest(1, least(x2 + dx, 500)) AS x2, greatest(1, least(y2 + dy, 500)) AS y2 FROM e")
register("M15_infer_grid", lambda s, d: G.inferred_grid(boxes(s, d)), f"WITH {B_SQL}, cy AS (SELECT DISTINCT page_id, (y1 + y2) // 2 AS m FROM boxes), cx AS (SELECT DISTINCT page_id, (x1 + x2) // 2 AS m FROM boxes), gy AS (SELECT page_id, 1 + count(*) FILTER (g > 50) AS n FROM (SELECT page_id, m - lag(m) OVER (PARTITION BY page_id ORDER BY m) AS g FROM cy) GROUP BY 1), gx AS (SELECT page_id, 1 + count(*) FILTER (g > 50) AS n FROM (SELECT page_id, m - lag(m) OVER (PARTITION BY page_id ORDER BY m) AS g FROM cx) GROUP BY 1) SELECT page_id, concat_ws('x', gy.n, gx.n) AS grid FROM gy JOIN gx USING (page_id)")
for axis, name in (("y", "M16_seams_y"), ("x", "N25_seams_x")):
    register(name, lambda s, d, axis=axis: G.seams(boxes(s, d), axis), f"WITH {B_SQL} SELECT page_id, box_id, ({axis}2 + nxt) // 2 AS seam FROM (SELECT *, lead({axis}1) OVER (PARTITION BY page_id ORDER BY ({axis}1 + {axis}2) / 2, box_id) AS nxt FROM boxes) WHERE nxt IS NOT NULL")
register("M17_boxes_signature", lambda s, d: boxes(s, d).groupBy("page_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.format_string("%05d,%05d,%05d,%05d", "x1", "y1", "x2", "y2"))), ";"), 256), 1, 16).alias("signature")), f"WITH {B_SQL} SELECT page_id, substr(sha256(string_agg(printf('%05d,%05d,%05d,%05d', x1, y1, x2, y2), ';' ORDER BY printf('%05d,%05d,%05d,%05d', x1, y1, x2, y2))), 1, 16) AS signature FROM boxes GROUP BY 1")
register("M5_shape_candidates", lambda s, d: G.shape_candidates(boxes(s, d).select("page_id", "box_id", F.col("x1").alias("x"), (F.floor(F.col("y1") / 40) * 40).alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1") - 5).alias("height"))),
    f"WITH {B_SQL}, b AS (SELECT page_id, box_id, x1 AS x, y1 // 40 * 40 AS y, x2 - x1 AS width, y2 - y1 - 5 AS height FROM boxes), n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(height) OVER w AS nh FROM b WINDOW w AS (PARTITION BY page_id ORDER BY y, x, box_id)), g AS (SELECT *, CASE WHEN least(y + height, ny + nh) - greatest(y, ny) > 0 THEN nx - x - width END AS gap FROM n WHERE true), "
    "u AS (SELECT *, coalesce(avg(gap) OVER (PARTITION BY page_id), 5e0) AS usual FROM g) SELECT page_id, box_id, CASE WHEN gap <= 0 THEN 'touching_components' ELSE 'abnormal_kerning' END AS reason FROM u WHERE nx IS NOT NULL AND (gap <= 0 OR (gap < usual * 0.3e0 AND usual > 2)) UNION ALL SELECT page_id, box_id, 'wide_aspect_ratio' FROM u WHERE width >= 10 AND height > 0 AND width::DOUBLE / height > 8")  # fmt: skip
cond = []
for names, earlier, least, base, goes in G.SUPPRESSION:
    share = {"new": "of_new", "old": "of_old", "both": "least(of_new, of_old)"}[base]
    cond.append(f"SELECT page_id, {'n_id' if goes == 'new' else 'o_id'} AS box_id FROM pr WHERE n_name IN ({', '.join(repr(x) for x in names)}) AND o_name IN ({', '.join(repr(x) for x in earlier)}) AND {share} > {least}e0")
block = ", ".join(repr(x) for x in G.LINE_BLOCKERS)
cond.append(f"SELECT page_id, n_id FROM pr WHERE n_name = 'DefaultLine' AND o_name IN ({block})")
cond.append(f"SELECT page_id, o_id FROM pr p WHERE n_name = 'DefaultLine' AND o_name = 'Main script black' AND of_old > 0.6e0 AND NOT EXISTS (SELECT 1 FROM pr q WHERE q.page_id = p.page_id AND q.n_id = p.n_id AND q.o_name IN ({block}))")
SUP_SQL = f"{B_SQL}, pr AS (SELECT n.page_id, n.box_id AS n_id, o.box_id AS o_id, n.name AS n_name, o.name AS o_name, i::DOUBLE / ((n.x2 - n.x1) * (n.y2 - n.y1)) AS of_new, i::DOUBLE / ((o.x2 - o.x1) * (o.y2 - o.y1)) AS of_old FROM (SELECT n, o, greatest(least(n.x2, o.x2) - greatest(n.x1, o.x1), 0) * greatest(least(n.y2, o.y2) - greatest(n.y1, o.y1), 0) AS i FROM boxes n JOIN boxes o ON n.page_id = o.page_id AND o.box_id < n.box_id AND o.x1 <= n.x2 AND n.x1 <= o.x2 AND o.y1 <= n.y2 AND n.y1 <= o.y2)), gone AS ({' UNION '.join(cond)})"
register("J11_J12_J19_suppressed", lambda s, d: G.suppressed(boxes(s, d)), f"WITH {SUP_SQL} SELECT DISTINCT page_id, box_id FROM gone")
register("J20_kept_annotations", lambda s, d: boxes(s, d).join(G.suppressed(boxes(s, d)), ["page_id", "box_id"], "left_anti").groupBy("name").agg(F.count("*").alias("n")), f"WITH {SUP_SQL} SELECT name, count(*) AS n FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page_id = b.page_id AND g.box_id = b.box_id) GROUP BY 1")
register("J13_P38_unified", lambda s, d: G.unified(boxes(s, d), ["MainZone", "MarginTextZone"]))
register("W10_W11_merged_boxes", lambda s, d: G.merged_boxes(boxes(s, d)))
register("W9_reading_order", lambda s, d: G.reading_order(boxes(s, d), 500), f"WITH {B_SQL}, m AS (SELECT *, (x1 + x2)::DOUBLE / 2 AS m FROM boxes), g AS (SELECT *, m - lag(m) OVER (PARTITION BY page_id ORDER BY m, box_id) AS gap FROM m), f AS (SELECT *, first_value(gap) OVER w AS bg, first_value(m) OVER w AS bm FROM g WINDOW w AS (PARTITION BY page_id ORDER BY gap DESC NULLS LAST, m DESC)), c AS (SELECT *, CASE WHEN bg > 40 AND m >= bm THEN 1 ELSE 0 END AS \"column\" FROM f) SELECT page_id, box_id, \"column\", row_number() OVER (PARTITION BY page_id ORDER BY \"column\", y1, x1, box_id) AS place FROM c")
register("N14_N16_coco_records", lambda s, d: boxes(s, d).select("page_id", "box_id", "name", "x1", "y1", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")), f"WITH {B_SQL} SELECT page_id, box_id, name, x1, y1, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area FROM boxes")


def corners():
    return F.array(F.array("x1", "y1"), F.array("x1", "y2"), F.array("x2", "y2"), F.array("x2", F.col("y1") + 3))



def shoelace(s, d):
    n = F.size("p")
    twice = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("p")[i][0] * F.col("p")[(i + 1) % n][1] - F.col("p")[(i + 1) % n][0] * F.col("p")[i][1]), F.lit(0), lambda a, x: a + x)
    return boxes(s, d).withColumn("p", corners()).select("page_id", "box_id", (F.abs(twice) / 2).alias("area"))


register("N15_polygon_area", shoelace, f"WITH {B_SQL} SELECT page_id, box_id, abs(x1 * y2 - x1 * y1 + x1 * y2 - x2 * y2 + x2 * (y1 + 3) - x2 * y2 + x2 * y1 - x1 * (y1 + 3))::DOUBLE / 2 AS area FROM boxes")
register("N17_N22_polygon_bbox", lambda s, d: boxes(s, d).withColumn("p", corners()).select("page_id", "box_id", F.array_min(F.transform("p", lambda q: q[0])).alias("left_x"), F.array_min(F.transform("p", lambda q: q[1])).alias("top_y"), F.array_max(F.transform("p", lambda q: q[0])).alias("right_x"), F.array_max(F.transform("p", lambda q: q[1])).alias("bottom_y")), f"WITH {B_SQL} SELECT page_id, box_id, x1 AS left_x, y1 AS top_y, x2 AS right_x, greatest(y2, y1 + 3) AS bottom_y FROM boxes")
register("N11_N21_flat_polygons", lambda s, d: boxes(s, d).select("page_id", "box_id", F.array_join(F.flatten(corners()), ",").alias("flat")), f"WITH {B_SQL} SELECT page_id, box_id, concat_ws(',', x1, y1, x1, y2, x2, y2, x2, y1 + 3) AS flat FROM boxes")
register("W22_W23_bands", lambda s, d: pages(s, d).select("page_id", F.least(F.greatest(F.round(F.col("height") / 260).cast("int"), F.lit(5)), F.lit(8)).alias("bands"), F.when(F.col("width") >= 1100, 2).otherwise(1).alias("cols")), f"WITH {P_SQL} SELECT page_id, least(greatest(round(height::DOUBLE / 260)::INT, 5), 8) AS bands, CASE WHEN width >= 1100 THEN 2 ELSE 1 END AS cols FROM pages")
register("W25_W26_region_keys", lambda s, d: boxes(s, d).select("page_id", "box_id", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "x2", "y2", "box_id")).alias("place")), f"WITH {B_SQL} SELECT page_id, box_id, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, x2, y2, box_id) AS place FROM boxes")


def chosen_regions(s, d):
    """The topmost and smallest region for initials, the lowest for page numbers, else the largest; one for each page and class."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    first = F.when(F.col("name") == "Page Number", -F.col("y2")).when(F.col("name").isin("DropCapitalZone", "Embellished"), F.col("y1")).otherwise(-size)
    second = F.when(F.col("name").isin("DropCapitalZone", "Embellished"), size).otherwise(F.lit(0))
    return boxes(s, d).withColumn("k", F.row_number().over(Window.partitionBy("page_id", "name").orderBy(first, second, "box_id"))).where("k = 1").select("page_id", "name", "box_id")


register("P26_chosen_regions", chosen_regions, f"WITH {B_SQL} SELECT page_id, name, box_id FROM boxes QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY CASE WHEN name = 'Page Number' THEN -y2 WHEN name IN ('DropCapitalZone', 'Embellished') THEN y1 ELSE -(x2 - x1) * (y2 - y1) END, CASE WHEN name IN ('DropCapitalZone', 'Embellished') THEN (x2 - x1) * (y2 - y1) ELSE 0 END, box_id) = 1")


def padding():
    share = F.when(F.col("name").isin("DefaultLine", "Main script black"), 0.03).otherwise(0.05)
    return F.floor((F.col("x2") - F.col("x1")) * share)


register("M18_expand_bbox", lambda s, d: boxes(s, d).select("page_id", "box_id", F.greatest(F.lit(0), F.col("x1") - padding()).alias("x1"), F.least(F.lit(500), F.col("x2") + padding()).alias("x2")), f"WITH {B_SQL} SELECT page_id, box_id, greatest(0, x1 - dx) AS x1, least(500, x2 + dx) AS x2 FROM (SELECT *, floor((x2 - x1) * CASE WHEN name IN ('DefaultLine', 'Main script black') THEN 0.03e0 ELSE 0.05e0 END)::BIGINT AS dx FROM boxes)")
register("M7_clipped_rects", lambda s, d: boxes(s, d).select("page_id", "box_id", F.greatest("x1", F.lit(30)).alias("x1"), F.least("x2", F.lit(280)).alias("x2"), "y1", "y2").where("x2 - x1 >= 8"), f"WITH {B_SQL} SELECT * FROM (SELECT page_id, box_id, greatest(x1, 30) AS x1, least(x2, 280) AS x2, y1, y2 FROM boxes) WHERE x2 - x1 >= 8")
register("J15_location_suggestions", lambda s, d: boxes(s, d).where((F.col("x2") - F.col("x1") >= 8) & ~F.col("name").isin("GraphicZone", "Diagram")).withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "box_id"))).where("k <= 80").select("page_id", "k", "name", "box_id"), f"WITH {B_SQL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, box_id) AS k, name, box_id FROM boxes WHERE x2 - x1 >= 8 AND name NOT IN ('GraphicZone', 'Diagram') QUALIFY k <= 80")


def assigned_columns(s, d):
    """Each text box goes to the zone of its page that covers most of it (+0.25 if its centre is inside, more than 0.05)."""
    b = boxes(s, d)
    zones = b.where(F.col("name").isin("MainZone", "MarginTextZone")).select("page_id", F.col("box_id").alias("zone_id"), *[F.col(c).alias(f"z_{c}") for c in ("x1", "y1", "x2", "y2")])
    rows = b.where("name = 'Main script black'")
    both = F.greatest(F.least("x2", "z_x2") - F.greatest("x1", "z_x1"), F.lit(0)) * F.greatest(F.least("y2", "z_y2") - F.greatest("y1", "z_y1"), F.lit(0))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    score = both / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) + F.when(mx.between(F.col("z_x1"), F.col("z_x2")) & my.between(F.col("z_y1"), F.col("z_y2")), 0.25).otherwise(0.0)
    return rows.join(zones, "page_id").withColumn("score", F.round(score, 6)).where("score > 0.05").groupBy("page_id", "box_id").agg(F.max_by("zone_id", F.struct("score", -F.col("zone_id"))).alias("zone_id"))


register("C7_C11_regions_by_label", lambda s, d: boxes(s, d).groupBy("page_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("box_id")), lambda x: x.cast("string")), ",").alias("ids")), f"WITH {B_SQL} SELECT page_id, name, string_agg(box_id::VARCHAR, ',' ORDER BY box_id) AS ids FROM boxes GROUP BY 1, 2")
