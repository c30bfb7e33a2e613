"""Tiling plans for another attempt at a page, as DataFrames of boxes (page_id, box_id, x1, y1, x2, y2)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import geometry as G

# Grids in the order they are tried, half width of a seam, least height of a band and area of a box.
GRIDS = [(2, 2), (3, 2), (2, 3), (3, 3), (4, 2)]
SEAM, LEAST_BAND, LEAST_AREA = 16, 40, 1600


def signature() -> Column:
    """Of all boxes of a group: a hash that does not depend on their order."""
    box = F.format_string("%d,%d,%d,%d", "x1", "y1", "x2", "y2")
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(box)), ";"), 256), 1, 16)


def signatures(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_id").agg(signature().alias("signature"), F.count("*").alias("tiles"))


def shifted_grids(pages: DataFrame, before: DataFrame, overlap: float = 0.15) -> DataFrame:
    """Per page the first grid whose boxes differ from those before, with its boxes; else three offset rows.

    ``before``: signatures.  Every grid is made for all pages at once and the
    choice is a minimum by page.
    """
    tries = [G.grid(pages, r, c, overlap).withColumn("try", F.lit(k)).withColumn("grid", F.lit(f"{r}x{c}")) for k, (r, c) in enumerate(GRIDS)]
    tries.append(G.grid(pages, 3, 1, overlap, 0.33).withColumn("try", F.lit(len(GRIDS))).withColumn("grid", F.lit("3x1_offset")))
    boxes = reduce(DataFrame.unionByName, tries)
    signed = boxes.groupBy("page_id", "try").agg(signature().alias("own")).join(before, "page_id", "left")
    chosen = signed.where(~F.col("own").eqNullSafe(F.col("signature")) | (F.col("try") == len(GRIDS))).groupBy("page_id").agg(F.min("try").alias("try"))
    return boxes.join(chosen, ["page_id", "try"]).select("page_id", (F.col("r") * 100 + F.col("c")).cast("long").alias("box_id"), "x1", "y1", "x2", "y2", "grid")


def _edges(seams: Column, size: Column) -> Column:
    """Cuts on both sides of the seams, none nearer than a band to the one before, from 0 to ``size``."""
    cuts = F.concat(F.array(F.lit(0).cast("long"), size), F.transform(seams, lambda s: F.greatest(F.lit(0).cast("long"), s - SEAM)), F.transform(seams, lambda s: F.least(size, s + SEAM)))
    far = F.aggregate(F.array_sort(F.array_distinct(cuts)), F.array().cast("array<bigint>"), lambda kept, y: F.when((F.size(kept) == 0) | (y - F.element_at(kept, -1) >= LEAST_BAND), F.concat(kept, F.array(y))).otherwise(kept))
    return F.when(F.element_at(far, -1) != size, F.concat(far, F.array(size))).otherwise(far)


def seam_bands(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tiles between the seams of the boxes before, without slivers and, where others are left, without thin tiles on a seam."""
    of = lambda axis: G.seams(boxes, axis).groupBy("page_id").agg(F.array_sort(F.collect_list("seam")).alias(f"seams_{axis}"))
    cut = pages.join(of("y"), "page_id").join(of("x"), "page_id")
    cut = cut.withColumn("ys", _edges(F.col("seams_y"), F.col("height").cast("long"))).withColumn("xs", _edges(F.col("seams_x"), F.col("width").cast("long")))
    spans = lambda edges, name: F.posexplode(F.arrays_zip(F.slice(edges, 1, F.size(edges) - 1).alias("a"), F.slice(edges, 2, F.size(edges) - 1).alias("b"))).alias(f"{name}_i", name)
    rows = cut.select("page_id", "width", "height", "seams_y", "xs", spans(F.col("ys"), "v")).select("page_id", "width", "height", "seams_y", "v_i", "v", spans(F.col("xs"), "h"))
    tiles = rows.select("page_id", (F.col("v_i") * 1000 + F.col("h_i")).cast("long").alias("box_id"), "seams_y", *G.clip(F.col("h.a"), F.col("v.a"), F.col("h.b"), F.col("v.b"), F.col("width"), F.col("height")))
    tiles = tiles.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= LEAST_AREA)
    thin = F.exists("seams_y", lambda s: (F.col("y1") <= s + SEAM) & (F.col("y2") >= s - SEAM) & (F.col("y2") - F.col("y1") < 3 * SEAM))
    tiles = tiles.withColumn("thin", thin)
    others = F.min("thin").over(Window.partitionBy("page_id"))
    return tiles.withColumn("all_thin", others).where(~F.col("thin") | F.col("all_thin")).select("page_id", "box_id", "x1", "y1", "x2", "y2")


# ---- the same rules on one page: sizes are (width, height), boxes (box_id, x1, y1, x2, y2) -----------

Size = tuple[float, float]
Box = tuple[int, int, int, int, int]
#: For null in the rows of ``retry_strategies``.  It bounds nothing, as in the column functions.
UNKNOWN = -(2**31)


def _within(least: int, v: float, top: float) -> float:
    v = min(v, top)
    return least if v == math.inf else max(least, v)


def clip_box(box_id: int, x1: int, y1: int, x2: int, y2: int, size: Size) -> Box:
    width, height = size
    return box_id, _within(0, x1, width - 1), _within(0, y1, height - 1), _within(1, x2, width), _within(1, y2, height)


@lru_cache(maxsize=16_384)
def _grid_spans(side: float, n: int, overlap: float, shift: float) -> list[tuple]:
    """From where to where the n tiles along a side go; pages share their sides."""
    step = max(1, math.floor(side / n)) if side < math.inf else 1
    grown = max(4, math.floor(step * overlap))
    cuts = [i * step + math.floor(step * shift) for i in range(n)]
    spans = [(max(0, a - grown) if i else a, min(side, a + step + grown) if i < n - 1 else a + step) for i, a in enumerate(cuts)]
    return [(_within(0, a, side - 1), _within(1, b, side)) for a, b in spans]


def grid_boxes(size: Size, rows: int, cols: int, overlap: float, shift: float = 0.0) -> list[Box]:
    across, down = _grid_spans(size[0], cols, overlap, 0.0), _grid_spans(size[1], rows, overlap, shift)
    return [(r * 100 + c, x1, y1, x2, y2) for r, (y1, y2) in enumerate(down) for c, (x1, x2) in enumerate(across)]


def wider_boxes(boxes: list[Box], size: Size, expand: float) -> list[Box]:
    grown = ((i, x1, y1, x2, y2, max(4, math.floor((x2 - x1) * expand)), max(4, math.floor((y2 - y1) * expand))) for i, x1, y1, x2, y2 in boxes)
    return [clip_box(i, x1 - dx, y1 - dy, x2 + dx, y2 + dy, size) for i, x1, y1, x2, y2, dx, dy in grown]


def band_boxes(boxes: list[Box], sizes: list[Size]) -> list[Box]:
    """What ``seam_bands`` gives for a page."""

    def seams(low: int, high: int) -> list[int]:
        order = sorted(((b[low] + b[high]) / 2, b[0], b[low], b[high]) for b in boxes)
        return [(a[3] + b[2]) // 2 for a, b in zip(order, order[1:])]

    def spans(found: list[int], size: float) -> list[tuple]:
        far: list = []
        for y in sorted({0, size, *(max(0, s - SEAM) for s in found), *(min(size, s + SEAM) for s in found)}):
            if not far or y - far[-1] >= LEAST_BAND:
                far.append(y)
        return list(zip(far, far[1:] if far[-1] == size else [*far[1:], size]))

    if len(boxes) < 2:
        return []
    seams_y, seams_x = seams(2, 4), seams(1, 3)
    cut = [clip_box(v * 1000 + h, xs[0], ys[0], xs[1], ys[1], size) for size in sizes for v, ys in enumerate(spans(seams_y, size[1])) for h, xs in enumerate(spans(seams_x, size[0]))]
    tiles = [t for t in cut if (t[3] - t[1]) * (t[4] - t[2]) >= LEAST_AREA]
    thin = lambda t: t[4] - t[2] < 3 * SEAM and any(t[2] <= s + SEAM and t[4] >= s - SEAM for s in seams_y)
    return [t for t in tiles if not thin(t)] or tiles


def hashed(boxes: list[Box]) -> str:
    """``signature`` of the boxes."""
    return hashlib.sha256(";".join(sorted([f"{x1},{y1},{x2},{y2}" for _, x1, y1, x2, y2 in boxes])).encode()).hexdigest()[:16]


def attempts(boxes: list[Box], sizes: list[Size], overlap: float, expand: float) -> Iterator[tuple[str, list[Box]]]:
    """Plans in the order they are tried, each made when it is asked for.

    A page without seams has its shifted grid for bands; that was tried before.
    """
    for r, c, shift in [*((r, c, 0.0) for r, c in GRIDS), (3, 1, 0.33)]:
        yield "grid_shift", [t for size in sizes for t in grid_boxes(size, r, c, overlap, shift)]
    yield "seam_band_crop", band_boxes(boxes, sizes)
    yield "expand_overlap", [t for size in sizes for t in wider_boxes(boxes, size, expand)]


def first_changed(boxes: list[Box], sizes: list[Size], overlap: float = 0.15, expand: float = 0.22) -> tuple[str, str, int] | None:
    """(strategy, signature, tiles) of the first plan whose boxes are not those before."""
    before = hashed(boxes)
    for strategy, tiles in attempts(boxes, sizes, overlap, expand):
        if tiles and (own := hashed(tiles)) != before:
            return strategy, own, len(tiles)
    return None


def retry_strategies(pages: DataFrame, boxes: DataFrame, tiled: Callable[[int, list[Size], list[Box]], list[Box]], overlap: float = 0.15, expand: float = 0.22) -> DataFrame:
    """(page_id, strategy, signature, tiles): the first of grid shift, seam bands and wider overlap that changes the boxes.

    ``tiled`` says from the id, sizes (one, where page_id is a key) and ``boxes`` of
    a page what it was tiled by.  A page is shuffled as its size and boxes; tiles,
    some 80 a page, live only while it is looked at.
    """

    def run(page_id: int, given: list, ids: list, *sides: list) -> list[tuple]:
        many = sum(given)
        sides = [[math.inf if v == UNKNOWN else v for v in side] for side in sides]
        sizes = list(zip(sides[0][:many], sides[1][:many]))
        now = tiled(page_id, sizes, list(zip(ids[many:], *(v[many:] for v in sides))))
        found = first_changed(now, sizes, overlap, expand) if now else None
        return [(page_id, *found)] if found else []

    none = F.lit(0)
    sizes = pages.repartition("page_id").select("page_id", F.lit(1).alias("given"), none.cast("long").alias("box_id"), F.col("width").alias("x1"), F.col("height").alias("y1"), none.alias("x2"), none.alias("y2"))
    rows = sizes.unionByName(boxes.select("page_id", none.alias("given"), "box_id", "x1", "y1", "x2", "y2")).where("page_id IS NOT NULL")
    rows = rows.fillna(UNKNOWN, ["box_id", "x1", "y1", "x2", "y2"])
    return G.per_page(rows, [F.desc("given")], run, "page_id long, strategy string, signature string, tiles long")


def same_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page_id, identical): whether both hold the same boxes of a page, as often."""
    count = lambda t, name: t.groupBy("page_id", "x1", "y1", "x2", "y2").agg(F.count("*").alias(name))
    both = count(a, "n").join(count(b, "m"), ["page_id", "x1", "y1", "x2", "y2"], "full")
    return both.groupBy("page_id").agg(F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("identical"))


# ---- baselines of polygons -------------------------------------------------------------


def intersections(polygon: Column, x: Column) -> Column:
    """Heights at which the edges of a polygon line (array of [x, y]) meet the vertical at ``x``; both ends of a vertical edge within 1."""
    edges = F.transform(F.sequence(F.lit(1), F.size(polygon) - 1), lambda i: F.struct(F.element_at(polygon, i).alias("p"), F.element_at(polygon, i + 1).alias("q")))

    def meet(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"][0], e["p"][1], e["q"][0], e["q"][1]
        inside = (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2))
        return F.when(x1 == x2, F.when(F.abs(x - x1) <= 1.0, F.array(y1, y2))).when(inside, F.array(y1 + (x - x1) / (x2 - x1) * (y2 - y1)))

    return F.flatten(F.filter(F.transform(edges, meet), lambda v: v.isNotNull()))


def baseline(polygons: DataFrame, samples: int = 7) -> DataFrame:
    """(page_id, box_id, i, x, y): points at 0.78 of the depth of a polygon; ``polygons``: page_id, box_id, p, width, height."""
    xs = F.transform("p", lambda q: q[0])
    rows = polygons.withColumn("low", F.greatest(F.lit(0.0), F.array_min(xs))).withColumn("high", F.least((F.col("width") - 1).cast("double"), F.array_max(xs)))
    flat = F.array_max(F.transform("p", lambda q: q[1])) - F.greatest(F.lit(1.0), F.col("height") * 0.12)
    rows = rows.withColumn("flat", flat).withColumn("narrow", F.col("high") - F.col("low") < 5.0)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("narrow"), 1).otherwise(samples - 1))))
    rows = rows.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * (F.col("i") / F.when(F.col("narrow"), 1).otherwise(samples - 1)))
    rows = rows.withColumn("ys", intersections(F.col("p"), F.col("x")))
    top, bottom = F.array_min("ys"), F.array_max("ys")
    y = F.when(F.col("narrow") | (F.size("ys") == 0), F.col("flat")).when(F.size("ys") == 1, F.col("ys")[0]).otherwise(top + 0.78 * (bottom - top))
    return rows.select("page_id", "box_id", "i", F.round("x", 6).alias("x"), F.round(y, 6).alias("y"))
