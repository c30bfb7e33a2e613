"""Retry plans, polygons, columns and annotation records over the boxes of pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import geometry as G
from palimpsest.operators import retry as R
from palimpsest.plans.geometry import B_SQL, P_SQL, boxes, pages
from palimpsest.registry import register

XY = ["x1", "y1", "x2", "y2"]


def plans_before(s, d) -> DataFrame:
    """What a page was tiled by: two rows of two, three of two, or boxes of its own."""
    p = pages(s, d)
    kind = F.pmod("page_id", F.lit(3))
    made = lambda k, r, c: G.grid(p.where(kind == k), r, c, 0.15).select("page_id", (F.col("r") * 100 + F.col("c")).cast("long").alias("box_id"), *XY)
    own = boxes(s, d).join(p, "page_id").where(kind == 2).select("page_id", "box_id", *G.clip(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height")))
    return made(0, 2, 2).unionByName(made(1, 3, 2)).unionByName(own)


def tiled(page_id: int, sizes: list, own: list) -> list:
    """``plans_before`` of one page."""
    kind = page_id % 3
    return [t for z in sizes for t in ([R.clip_box(*b, z) for b in own] if kind == 2 else R.grid_boxes(z, 2 + kind, 2, 0.15))]


def retried(s, d) -> DataFrame:
    """Boxes are read for the pages that were tiled by them."""
    return R.retry_strategies(pages(s, d), boxes(s, d, F.pmod("l_orderkey", F.lit(3)) == 2), tiled)


def q_clip(x1, y1, x2, y2) -> str:
    return f"greatest(0, least({x1}, width - 1))::INT AS x1, greatest(0, least({y1}, height - 1))::INT AS y1, greatest(1, least({x2}, width))::INT AS x2, greatest(1, least({y2}, height))::INT AS y2"


def q_grid(source: str, r: int, c: int, shift: float = 0.0) -> str:
    return (
        f"SELECT page_id, (r * 100 + c)::BIGINT AS box_id, {q_clip('CASE WHEN c > 0 THEN greatest(0, xa - ox) ELSE xa END', 'CASE WHEN r > 0 THEN greatest(0, ya - oy) ELSE ya END', f'CASE WHEN c < {c - 1} THEN least(width, xa + tw + ox) ELSE xa + tw END', f'CASE WHEN r < {r - 1} THEN least(height, ya + th + oy) ELSE ya + th END')} FROM "
        f"(SELECT *, r * th + floor(th * {shift}e0)::INT AS ya, c * tw AS xa, greatest(4, floor(th * 0.15e0)::INT) AS oy, greatest(4, floor(tw * 0.15e0)::INT) AS ox FROM (SELECT *, greatest(1, height // {r}) AS th, greatest(1, width // {c}) AS tw FROM {source}, (SELECT unnest(range({r})) AS r), (SELECT unnest(range({c})) AS c)))"
    )


Q_SIGN = "substr(sha256(string_agg(printf('%d,%d,%d,%d', x1, y1, x2, y2), ';' ORDER BY printf('%d,%d,%d,%d', x1, y1, x2, y2))), 1, 16)"
BEFORE = (
    f"{B_SQL}, {P_SQL}, bef AS ({q_grid('(SELECT * FROM pages WHERE page_id % 3 = 0)', 2, 2)} UNION ALL {q_grid('(SELECT * FROM pages WHERE page_id % 3 = 1)', 3, 2)} UNION ALL SELECT page_id, box_id, {q_clip('x1', 'y1', 'x2', 'y2')} FROM boxes JOIN pages USING (page_id) WHERE page_id % 3 = 2), "
    f"bs AS (SELECT page_id, {Q_SIGN} AS signature FROM bef GROUP BY 1)"
)
TRIES = " UNION ALL ".join(f"SELECT *, {k} AS try, '{r}x{c}' AS grid FROM ({q_grid('pages', r, c)})" for k, (r, c) in enumerate(R.GRIDS)) + f" UNION ALL SELECT *, {len(R.GRIDS)}, '3x1_offset' FROM ({q_grid('pages', 3, 1, 0.33)})"
SHIFTED = (
    f"tries AS ({TRIES}), ts AS (SELECT page_id, try, {Q_SIGN} AS own FROM tries GROUP BY 1, 2), tc AS (SELECT page_id, min(try) AS try FROM ts LEFT JOIN bs USING (page_id) WHERE own IS DISTINCT FROM signature OR try = {len(R.GRIDS)} GROUP BY 1), shifted AS (SELECT page_id, box_id, x1, y1, x2, y2, grid FROM tries JOIN tc USING (page_id, try))"
)
register(
    "M10_grid_shift",
    lambda s, d: R.shifted_grids(pages(s, d), R.signatures(plans_before(s, d)).select("page_id", "signature")),
    f"WITH {BEFORE}, {SHIFTED} SELECT * FROM shifted",
)


def q_edges(seams: str, size: str) -> str:
    cuts = f"list_sort(list_distinct(list_concat(list_concat([0, {size}], list_transform({seams}, lambda s: greatest(0, s - {R.SEAM}))), list_transform({seams}, lambda s: least({size}, s + {R.SEAM})))))"
    far = f"list_reduce(list_transform({cuts}, lambda y: [y::BIGINT]), lambda kept, y: CASE WHEN y[1] - kept[-1] >= {R.LEAST_BAND} THEN list_concat(kept, y) ELSE kept END)"
    return f"(CASE WHEN {far}[-1] <> {size} THEN list_concat({far}, [{size}::BIGINT]) ELSE {far} END)"


def q_seams(axis: str) -> str:
    return f"(SELECT page_id, list(seam ORDER BY seam) AS seams_{axis} FROM (SELECT page_id, floor(({axis}2 + lead({axis}1) OVER (PARTITION BY page_id ORDER BY ({axis}1 + {axis}2) / 2, box_id)) / 2)::BIGINT AS seam FROM bef) WHERE seam IS NOT NULL GROUP BY 1)"


BANDS = (
    f"cut AS (SELECT page_id, width, height, seams_y, {q_edges('seams_y', 'height')} AS ys, {q_edges('seams_x', 'width')} AS xs FROM pages JOIN {q_seams('y')} USING (page_id) JOIN {q_seams('x')} USING (page_id)), "
    "vv AS (SELECT *, unnest(range(1, len(ys))) AS vi FROM cut), hh AS (SELECT *, unnest(range(1, len(xs))) AS hi FROM vv), "
    f"tiles AS (SELECT * FROM (SELECT page_id, ((vi - 1) * 1000 + hi - 1)::BIGINT AS box_id, seams_y, {q_clip('xs[hi]', 'ys[vi]', 'xs[hi + 1]', 'ys[vi + 1]')} FROM hh) WHERE (x2 - x1) * (y2 - y1) >= {R.LEAST_AREA}), "
    f"thin AS (SELECT *, len(list_filter(seams_y, lambda s: y1 <= s + {R.SEAM} AND y2 >= s - {R.SEAM} AND y2 - y1 < {3 * R.SEAM})) > 0 AS thin FROM tiles), bands AS (SELECT page_id, box_id, x1, y1, x2, y2 FROM (SELECT *, bool_and(thin) OVER (PARTITION BY page_id) AS all_thin FROM thin) WHERE NOT thin OR all_thin)"
)
register("M11_seam_band_crop", lambda s, d: R.seam_bands(pages(s, d), plans_before(s, d)), f"WITH {BEFORE}, {BANDS} SELECT * FROM bands")
register(
    "M13_retry_strategy",
    retried,
    f"WITH {BEFORE}, {SHIFTED}, {BANDS}, single AS (SELECT page_id FROM bef GROUP BY 1 HAVING count(*) < 2), band2 AS (SELECT * FROM bands UNION ALL SELECT page_id, box_id, x1, y1, x2, y2 FROM shifted WHERE page_id IN (SELECT page_id FROM single)), "
    f"wide AS (SELECT page_id, box_id, {q_clip('x1 - dx', 'y1 - dy', 'x2 + dx', 'y2 + dy')} FROM (SELECT *, greatest(4, floor((x2 - x1) * 0.22e0)::INT) AS dx, greatest(4, floor((y2 - y1) * 0.22e0)::INT) AS dy FROM bef JOIN pages USING (page_id))), "
    f"c AS (SELECT page_id, 0 AS k, 'grid_shift' AS strategy, {Q_SIGN} AS own, count(*) AS tiles FROM shifted GROUP BY 1 UNION ALL SELECT page_id, 1, 'seam_band_crop', {Q_SIGN}, count(*) FROM band2 GROUP BY 1 UNION ALL SELECT page_id, 2, 'expand_overlap', {Q_SIGN}, count(*) FROM wide GROUP BY 1) "
    "SELECT page_id, strategy, own AS signature, tiles FROM c JOIN bs USING (page_id) WHERE own <> signature QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) = 1",
)


def later(s, d) -> DataFrame:
    """The boxes of a second attempt: the same in another order, or one of them moved."""
    move = F.when((F.pmod("page_id", F.lit(2)) == 0) & (F.col("x1") == F.min("x1").over(Window.partitionBy("page_id"))), 3).otherwise(0)
    return plans_before(s, d).select("page_id", (-F.col("box_id")).alias("box_id"), (F.col("x1") + move).cast("int").alias("x1"), "y1", "x2", "y2")


LATER = "lat AS (SELECT page_id, -box_id AS box_id, x1 + CASE WHEN page_id % 2 = 0 AND x1 = min(x1) OVER (PARTITION BY page_id) THEN 3 ELSE 0 END AS x1, y1, x2, y2 FROM bef)"
Q_SAME = "sa AS (SELECT page_id, list((x1, y1, x2, y2) ORDER BY (x1, y1, x2, y2)) AS l FROM bef GROUP BY 1), sb AS (SELECT page_id, list((x1, y1, x2, y2) ORDER BY (x1, y1, x2, y2)) AS l FROM lat GROUP BY 1), same AS (SELECT page_id, sa.l = sb.l AS identical FROM sa JOIN sb USING (page_id))"
register("X9_identical_boxes", lambda s, d: R.same_boxes(plans_before(s, d), later(s, d)), f"WITH {BEFORE}, {LATER}, {Q_SAME} SELECT * FROM same")


def noop_retries(s, d) -> DataFrame:
    """A retry that changed nothing: an equal, non-empty text hash or equal boxes."""
    texts = pages(s, d).select("page_id", F.when(F.col("page_id") % 5 != 0, F.md5(F.col("width").cast("string"))).otherwise("").alias("before"), F.when(F.col("page_id") % 5 != 0, F.md5((F.col("width") + F.col("page_id") % 3).cast("string"))).otherwise("").alias("after"))
    same = (F.col("before") != "") & (F.col("before") == F.col("after"))
    return texts.join(R.same_boxes(plans_before(s, d), later(s, d)), "page_id").select("page_id", (same | F.col("identical")).alias("noop"))


register("M14_noop_retry", noop_retries, f"WITH {BEFORE}, {LATER}, {Q_SAME} SELECT page_id, (page_id % 5 <> 0 AND page_id % 3 = 0) OR identical AS noop FROM pages JOIN same USING (page_id)")

# ---- polygons ----------------------------------------------------------------------------


def polygons(s, d) -> DataFrame:
    """Closed outlines of boxes with one slanted side; some boxes are narrow."""
    x2 = F.when(F.col("box_id") % 9 == 0, F.col("x1") + 3).otherwise(F.col("x2")).cast("double")
    x1, y1, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "y2"))
    point = lambda x, y: F.array(x, y)
    return boxes(s, d).join(pages(s, d), "page_id").select("page_id", "box_id", "width", "height", F.array(point(x1, y1), point(x2, y1 + 4), point(x2, y2), point(x1 + 1, y2 - 2), point(x1, y1)).alias("p"))


Q_POLY = "poly AS (SELECT page_id, box_id, width, height, x1::DOUBLE AS a, CASE WHEN box_id % 9 = 0 THEN x1 + 3 ELSE x2 END::DOUBLE AS b, y1::DOUBLE AS t, y2::DOUBLE AS u FROM boxes JOIN pages USING (page_id))"
Q_EDGES = "edge AS (SELECT page_id, box_id, unnest([[a, t, b, t + 4], [b, t + 4, b, u], [b, u, a + 1, u - 2], [a + 1, u - 2, a, t]]) AS e, unnest([0, 1, 2, 3]) AS k FROM poly)"
Q_MEET = "CASE WHEN e[1] = e[3] THEN CASE WHEN abs(x - e[1]) <= 1 THEN [e[2], e[4]] END WHEN x BETWEEN least(e[1], e[3]) AND greatest(e[1], e[3]) THEN [e[2] + (x - e[1]) / (e[3] - e[1]) * (e[4] - e[2])] END"
register(
    "M19_vertical_intersections",
    lambda s, d: polygons(s, d).select("page_id", "box_id", F.transform(R.intersections(F.col("p"), F.col("p")[0][0] + 2), lambda y: F.round(y, 6)).alias("ys")).select("page_id", "box_id", F.size("ys").alias("n"), F.array_min("ys").alias("top"), F.array_max("ys").alias("bottom")),
    f"WITH {B_SQL}, {P_SQL}, {Q_POLY}, {Q_EDGES}, m AS (SELECT page_id, box_id, unnest({Q_MEET}) AS y FROM (SELECT edge.*, a + 2 AS x FROM edge JOIN poly USING (page_id, box_id))) SELECT p.page_id, p.box_id, count(y)::INT AS n, min(round(y, 6)) AS top, max(round(y, 6)) AS bottom FROM poly p LEFT JOIN m ON m.page_id = p.page_id AND m.box_id = p.box_id GROUP BY 1, 2",
)
register(
    "M20_baseline",
    lambda s, d: R.baseline(polygons(s, d)),
    f"WITH {B_SQL}, {P_SQL}, {Q_POLY}, {Q_EDGES}, lim AS (SELECT *, greatest(0e0, least(a, b, a + 1)) AS low, least((width - 1)::DOUBLE, greatest(a, b, a + 1)) AS high, greatest(t + 4, u, t) - greatest(1e0, height * 0.12e0) AS flat FROM poly), "
    "sam AS (SELECT *, low + (high - low) * (i::DOUBLE / CASE WHEN high - low < 5 THEN 1 ELSE 6 END) AS x FROM (SELECT *, unnest(range(CASE WHEN high - low < 5 THEN 2 ELSE 7 END)) AS i FROM lim)), "
    f"m AS (SELECT page_id, box_id, i, unnest({Q_MEET}) AS y FROM sam JOIN edge USING (page_id, box_id)), g AS (SELECT page_id, box_id, i, count(y) AS n, min(y) AS lo, max(y) AS hi, any_value(y) AS one FROM m GROUP BY 1, 2, 3) "
    "SELECT s.page_id, s.box_id, s.i::INT AS i, round(x, 6) AS x, round(CASE WHEN high - low < 5 OR n IS NULL OR n = 0 THEN flat WHEN n = 1 THEN one ELSE lo + 0.78e0 * (hi - lo) END, 6) AS y FROM sam s LEFT JOIN g ON g.page_id = s.page_id AND g.box_id = s.box_id AND g.i = s.i",
)

# ---- regions in reading order (J16, W12, W13) ----------------------------------------------


def is_column(name):
    return F.lower(name).rlike("column|mainzone|main zone|text zone|main text area")


def text_rows(s, d) -> tuple[DataFrame, DataFrame]:
    """Usable boxes of columns with their place from left to right, and text boxes: of the classes for lines, or, where a page has none, of margins."""
    usable = boxes(s, d).where((F.col("x2") - F.col("x1") >= 8) & (F.col("y2") - F.col("y1") >= 8))
    columns = usable.where(is_column(F.col("name"))).select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("x1", "y1", "box_id")).alias("place"), *[F.col(c).alias(f"c_{c}") for c in XY])
    rows = usable.where(F.col("name").isin("Main script black", "DefaultLine", "MarginTextZone"))
    liked = F.col("name").isin("Main script black", "DefaultLine")
    return columns, rows.withColumn("any_liked", F.max(liked).over(Window.partitionBy("page_id"))).where(liked | ~F.col("any_liked"))


def in_columns(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Text boxes of pages with columns in reading order: by the column that holds most of each, else behind all columns."""
    both = F.greatest(F.least("x2", "c_x2") - F.greatest("x1", "c_x1"), F.lit(0)) * F.greatest(F.least("y2", "c_y2") - F.greatest("y1", "c_y1"), F.lit(0))
    score = both / F.greatest(F.lit(1), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) + F.when(((F.col("x1") + F.col("x2")) / 2).between(F.col("c_x1"), F.col("c_x2")), 0.25).otherwise(0.0)
    scored = rows.join(columns, "page_id").withColumn("score", F.round(score, 9))
    best = scored.groupBy("page_id", "box_id", "x1", "y1").agg(F.max(F.struct("score", (-F.col("place")).alias("m"))).alias("b"))
    dealt = best.select("page_id", "box_id", "x1", "y1", F.when(F.col("b.score") > 0.05, -F.col("b.m")).otherwise(1_000_000).cast("int").alias("col"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("col", "y1", "x1", "box_id")) - 1
    return dealt.select("page_id", "box_id", place.alias("reading_order"))


def segmented(s, d) -> DataFrame:
    """Text boxes in reading order: by the column that holds most of each, else behind all columns; without columns by gaps.

    A page with columns is a join and a window.  Without any, columns grow box by
    box, each decision resting on those before, so a page is taken as a whole.
    """
    columns, rows = text_rows(s, d)
    alone = rows.join(columns.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "box_id", *XY)
    grown = G.per_page(alone, [(F.col("x1") + F.col("x2")) / 2, "y1", "box_id"], _grown_order, "page_id long, box_id long, reading_order int")
    return in_columns(columns, rows).unionByName(grown)


def _column_of(x1s: list, x2s: list) -> list[int]:
    """Boxes by centre join the nearest column within the gap that a page's width allows, else begin one."""
    gap = max(80.0, (max(x2s) - min(x1s)) * 0.08)
    found: list[list] = []  # left, right, centre, sum of the centres, boxes
    of = []
    for x1, x2 in zip(x1s, x2s, strict=True):
        m = (x1 + x2) / 2
        near, least = None, gap
        for k, (left, right, centre, _, _) in enumerate(found):
            away = abs(m - centre) if min(x2, right) > max(x1, left) else max(x1 - right, left - x2, 0.0)
            if away < least or (away == least and near is None):
                near, least = k, away
        if near is None:
            near = len(found)
            found.append([x1, x2, m, 0.0, 0])
        c = found[near]
        total, n = c[3] + m, c[4] + 1
        found[near] = [min(c[0], x1), max(c[1], x2), total / n, total, n]
        of.append(near)
    rank = {k: i for i, k in enumerate(sorted(range(len(found)), key=lambda k: found[k][0]))}
    return [rank[k] for k in of]


def _grown_order(page_id: int, box_id: list, x1s: list, y1s: list, x2s: list, y2s: list) -> list[tuple]:
    order = sorted(zip(_column_of(x1s, x2s), y1s, x1s, box_id, strict=True))
    return [(page_id, box, i) for i, (_, _, _, box) in enumerate(order)]


def _grown_columns(page: pd.DataFrame) -> pd.DataFrame:
    """The columns of one page."""
    page = page.assign(m=(page["x1"] + page["x2"]) / 2).sort_values(["m", "y1", "box_id"])
    return page.assign(col=_column_of(page["x1"].tolist(), page["x2"].tolist()))[["page_id", "box_id", "x1", "y1", "col"]]


register("J16_segmented_regions", segmented)
Q_USABLE = f"{B_SQL}, us AS (SELECT * FROM boxes WHERE x2 - x1 >= 8 AND y2 - y1 >= 8), co AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, y1, box_id) AS place FROM us WHERE regexp_matches(lower(name), 'column|mainzone|main zone|text zone|main text area')), tx AS (SELECT * FROM (SELECT *, name IN ('Main script black', 'DefaultLine') AS liked, bool_or(name IN ('Main script black', 'DefaultLine')) OVER (PARTITION BY page_id) AS any_liked FROM us WHERE name IN ('Main script black', 'DefaultLine', 'MarginTextZone')) WHERE liked OR NOT any_liked)"
register(
    "J16_regions_in_columns",
    lambda s, d: in_columns(*text_rows(s, d)),
    f"WITH {Q_USABLE}, sc AS (SELECT t.page_id, t.box_id, t.x1, t.y1, c.place, round(greatest(least(t.x2, c.x2) - greatest(t.x1, c.x1), 0) * greatest(least(t.y2, c.y2) - greatest(t.y1, c.y1), 0)::DOUBLE / greatest(1, (t.x2 - t.x1) * (t.y2 - t.y1)) + CASE WHEN (t.x1 + t.x2)::DOUBLE / 2 BETWEEN c.x1 AND c.x2 THEN 0.25e0 ELSE 0e0 END, 9) AS score FROM tx t JOIN co c USING (page_id)), "
    "be AS (SELECT page_id, box_id, x1, y1, CASE WHEN score > 0.05e0 THEN place ELSE 1000000 END AS col FROM sc QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY score DESC, place) = 1) SELECT page_id, box_id, (row_number() OVER (PARTITION BY page_id ORDER BY col, y1, x1, box_id) - 1)::INT AS reading_order FROM be",
)


def _block_of(page_id: int, box_id: list, x1s: list, x2s: list) -> list[tuple]:
    """Boxes from left to right join the block that holds their centre, else the one that they share most width with or that is near."""
    groups: list[list] = []
    of = []
    for x1, x2 in zip(x1s, x2s, strict=True):
        m = (x1 + x2) / 2
        best = None
        for k, (left, right) in enumerate(groups):
            holds, shared, away = left <= m <= right, max(0.0, min(x2, right) - max(x1, left)), abs(m - (left + right) / 2)
            if holds or shared > 0 or away <= max(1.0, x2 - x1, right - left) * 0.75:
                fit = (float(holds), shared - away * 0.01, -k)
                best = fit if best is None or fit > best else best
        if best is not None and best[:2] > (-1.0, -1.0):
            k = -best[2]
            groups[k] = [min(groups[k][0], x1), max(groups[k][1], x2)]
        else:
            k = len(groups)
            groups.append([x1, x2])
        of.append(k)
    rank = {k: i for i, k in enumerate(sorted(range(len(groups)), key=lambda k: groups[k][0]))}
    return [(page_id, box, rank[k]) for box, k in zip(box_id, of, strict=True)]


def _blocks(page: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one page."""
    page = page.sort_values(["x1", "box_id"])
    return pd.DataFrame(_block_of(page["page_id"].iloc[0], *[page[c].tolist() for c in ("box_id", "x1", "x2")]), columns=["page_id", "box_id", "block"])


register("W13_region_blocks", lambda s, d: G.per_page(boxes(s, d).select("page_id", "box_id", "x1", "x2"), ["x1", "box_id"], _block_of, "page_id long, box_id long, block int"))


# A mask cell is so many pixels; boxes grow by so many cells; a block has so many cells and pixels a side at least.
CELL, GROWN, BLOCK_CELLS, BLOCK_SIDE = 4, 18, 400, 16


def _block_frames(page_id: int, x1s: list, y1s: list, x2s: list, y2s: list, widths: list, heights: list) -> list[tuple]:
    """Boxes painted on a coarse mask and grown; the frame of each set of touching ones, in pixels.

    Grown boxes stay rectangles, so two of them touch if they overlap, or lie next to
    each other with a side in common; no mask is needed.  A set is walked from box to
    box, each against those not yet met, so memory grows with the boxes, not their pairs.
    """
    width, height = widths[0], heights[0]
    right, bottom = max(1, width // CELL) - 1, max(1, height // CELL) - 1
    grown = []
    for x1, y1, x2, y2 in zip(x1s, y1s, x2s, y2s, strict=True):
        a, b = x1 // CELL, y1 // CELL
        grown.append((max(a - GROWN, 0), max(b - GROWN, 0), min(max(a + 1, x2 // CELL) + GROWN, right), min(max(b + 1, y2 // CELL) + GROWN, bottom)))
    out = []
    for members in _touching_sets(np.array(grown)) if len(grown) > FEW else _touching_few(grown):
        a, b, c, d = (f(x) for f, x in zip((min, min, max, max), zip(*members, strict=True), strict=True))
        if (c - a + 1) * (d - b + 1) < BLOCK_CELLS:
            continue
        frame = (a * CELL, b * CELL, min(width, (c + 1) * CELL), min(height, (d + 1) * CELL))
        if frame[2] - frame[0] >= BLOCK_SIDE and frame[3] - frame[1] >= BLOCK_SIDE:
            out.append((page_id, *frame))
    return out


def _raster_blocks(page: pd.DataFrame) -> pd.DataFrame:
    """The frames of one page."""
    return pd.DataFrame(_block_frames(page["page_id"].iloc[0], *[page[c].tolist() for c in (*XY, "width", "height")]), columns=["page_id", *XY])


#: Up to so many boxes a plain loop is faster than arrays.
FEW = 64


def _touching_few(left: list) -> list[list]:
    sets = []
    while left:
        members = [left.pop()]
        for a, b, c, d in members:
            rest = []
            for r in left:
                gx, gy = max(a, r[0]) - min(c, r[2]), max(b, r[1]) - min(d, r[3])
                (members if gx <= 1 and gy <= 1 and (gx <= 0 or gy <= 0) else rest).append(r)
            left = rest
        sets.append(members)
    return sets


def _touching_sets(left: np.ndarray) -> list[list]:
    sets = []
    while len(left):
        members, left = [left[-1].tolist()], left[:-1]
        for a, b, c, d in members:
            gx = np.maximum(a, left[:, 0]) - np.minimum(c, left[:, 2])
            gy = np.maximum(b, left[:, 1]) - np.minimum(d, left[:, 3])
            touch = (np.maximum(gx, gy) <= 1) & (np.minimum(gx, gy) <= 0)
            if touch.any():
                members += left[touch].tolist()
                left = left[~touch]
        sets.append(members)
    return sets


Q_GROWN = (
    f"gr AS (SELECT page_id, box_id, width, height, greatest(x1 // {CELL} - {GROWN}, 0) AS a, greatest(y1 // {CELL} - {GROWN}, 0) AS b, least(greatest(x1 // {CELL} + 1, x2 // {CELL}) + {GROWN}, greatest(1, width // {CELL}) - 1) AS c, least(greatest(y1 // {CELL} + 1, y2 // {CELL}) + {GROWN}, greatest(1, height // {CELL}) - 1) AS d FROM boxes JOIN pages USING (page_id)), "
    "gp AS (SELECT p.page_id, p.box_id AS i, q.box_id AS j, greatest(p.a, q.a) - least(p.c, q.c) AS gx, greatest(p.b, q.b) - least(p.d, q.d) AS gy FROM gr p JOIN gr q USING (page_id)), tp AS (SELECT page_id, i, j FROM gp WHERE gx <= 1 AND gy <= 1 AND (gx <= 0 OR gy <= 0))"
)
register(
    "W12_block_rects",
    lambda s, d: G.per_page(boxes(s, d).join(pages(s, d), "page_id").select("page_id", *XY, "width", "height"), [], _block_frames, "page_id long, x1 int, y1 int, x2 int, y2 int"),
    f"WITH RECURSIVE {B_SQL}, {P_SQL}, {Q_GROWN}, re AS (SELECT page_id, i, j FROM tp UNION SELECT re.page_id, re.i, tp.j FROM re JOIN tp ON tp.page_id = re.page_id AND tp.i = re.j), ro AS (SELECT page_id, i AS box_id, min(j) AS label FROM re GROUP BY 1, 2), "
    f"fr AS (SELECT page_id, label, min(a) AS a, min(b) AS b, max(c) AS c, max(d) AS d, any_value(width) AS width, any_value(height) AS height FROM gr JOIN ro USING (page_id, box_id) GROUP BY 1, 2 HAVING (max(c) - min(a) + 1) * (max(d) - min(b) + 1) >= {BLOCK_CELLS}) "
    f"SELECT * FROM (SELECT page_id, (a * {CELL})::INT AS x1, (b * {CELL})::INT AS y1, least(width, (c + 1) * {CELL})::INT AS x2, least(height, (d + 1) * {CELL})::INT AS y2 FROM fr) WHERE x2 - x1 >= {BLOCK_SIDE} AND y2 - y1 >= {BLOCK_SIDE}",
)

# ---- annotation records (A6, A27) -------------------------------------------------------------


def renumbered(s, d) -> DataFrame:
    """Images and annotations of all pages numbered from 1 without gaps: counts of page ranges first, then within a range."""
    b = boxes(s, d).withColumn("range", F.floor(F.col("page_id") / 1000))
    per_range = b.groupBy("range").agg(F.count("*").alias("anns"), F.countDistinct("page_id").alias("imgs"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  one row for 1,000 pages
    base = per_range.select("range", before("anns").alias("ann0"), before("imgs").alias("img0"))
    w = Window.partitionBy("range").orderBy("page_id", "box_id")
    return b.join(base, "range").select("page_id", "box_id", (F.col("ann0") + F.row_number().over(w)).alias("annotation"), (F.col("img0") + F.dense_rank().over(Window.partitionBy("range").orderBy("page_id"))).alias("image"))


register("A6_H13_merged_annotations", renumbered, f"WITH {B_SQL} SELECT page_id, box_id, row_number() OVER (ORDER BY page_id, box_id) AS annotation, dense_rank() OVER (ORDER BY page_id) AS image FROM boxes")


def coco_records(s, d) -> DataFrame:
    """One JSON record a page: image, annotations with box, area and category, and the categories in use."""
    b = boxes(s, d)
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    note = text('{"id":', num("box_id"), ',"image_id":', num("page_id"), ',"category":"', F.col("name"), '","bbox":[', num("x1"), ",", num("y1"), ",", num(w), ",", num(h), '],"area":', num(w * h), ',"iscrowd":0}')
    per_page = b.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", note.alias("note")))), lambda x: x["note"]), ",").alias("notes"), F.array_join(F.array_sort(F.collect_set(text('"', F.col("name"), '"'))), ",").alias("names"))
    record = text('{"images":[{"id":', num("page_id"), ',"width":', num("width"), ',"height":', num("height"), '}],"annotations":[', F.col("notes"), '],"categories":[', F.col("names"), "]}")
    return per_page.join(pages(s, d), "page_id").select("page_id", record.alias("record"))


register(
    "A27_coco_records",
    coco_records,
    f"WITH {B_SQL}, {P_SQL}, n AS (SELECT page_id, box_id, name, concat('{{\"id\":', box_id, ',\"image_id\":', page_id, ',\"category\":\"', name, '\",\"bbox\":[', x1, ',', y1, ',', x2 - x1, ',', y2 - y1, '],\"area\":', (x2 - x1) * (y2 - y1), ',\"iscrowd\":0}}') AS note FROM boxes), "
    "g AS (SELECT page_id, string_agg(note, ',' ORDER BY box_id) AS notes, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_distinct(list('\"' || name || '\"'))) AS x)) AS names FROM n GROUP BY 1) "
    "SELECT page_id, concat('{\"images\":[{\"id\":', page_id, ',\"width\":', width, ',\"height\":', height, '}],\"annotations\":[', notes, '],\"categories\":[', names, ']}') AS record FROM g JOIN pages USING (page_id)",
)


def batch_results(s, d) -> DataFrame:
    """Per page and class: its detections, the sum of the class over all pages so far, and an error instead of results for a page without text."""
    counts = boxes(s, d).groupBy("page_id", "name").agg(F.count("*").cast("long").alias("n"))
    failed = pages(s, d).select("page_id", F.when(F.col("width") < 640, "page too narrow").alias("error"))
    rows = counts.join(failed, "page_id").select("page_id", "name", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).alias("n"), "error")
    running = F.sum("n").over(Window.partitionBy("name").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("so_far", running)


register(
    "S56_batch_results",
    batch_results,
    f"WITH {B_SQL}, {P_SQL}, c AS (SELECT page_id, name, count(*) AS n FROM boxes GROUP BY 1, 2), r AS (SELECT page_id, name, CASE WHEN width < 640 THEN 0 ELSE n END AS n, CASE WHEN width < 640 THEN 'page too narrow' END AS error FROM c JOIN pages USING (page_id)) SELECT *, sum(n) OVER (PARTITION BY name ORDER BY page_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM r",
)
