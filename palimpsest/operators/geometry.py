"""Page geometry: tiles, seams, reading order, suppression of overlapping boxes.

Boxes are columns x1, y1, x2, y2.  Rules that look at all boxes of a page at once
are joins and windows by page; those whose decisions feed later ones run per page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT_CLASSES = ["Main script black", "Main script coloured", "Variant script black", "Variant script coloured", "Plain initial- coloured", "Plain initial - Highlighted", "Plain initial - Black"]
INITIALS = ["Embellished", "Plain initial- coloured", "Plain initial - Highlighted", "Plain initial - Black", "Inhabited"]
#: new class, earlier classes, least share, area that it is a share of, which box goes (fixed values)
SUPPRESSION = [
    (TEXT_CLASSES, ["MarginTextZone", "NumberingZone"], 0.7, "new", "new"),
    (INITIALS, ["DropCapitalZone", "GraphicZone"], 0.4, "both", "old"),
    (["Page Number"], ["NumberingZone"], 0.8, "new", "new"),
    (["Music"], ["MusicZone", "GraphicZone"], 0.7, "new", "old"),
    (["Table"], ["MainZone", "MarginTextZone"], 0.4, "old", "old"),
    (["Diagram", "Illustrations"], ["GraphicZone"], 0.5, "new", "old"),
]
LINE_BLOCKERS = ["Variant script coloured", "Variant script black", "Main script coloured", "NumberingZone", "Diagram", "MarginTextZone", "RunningTitleZone", "Table", "Quire Mark"]


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    low = lambda v, top: F.greatest(F.lit(0), F.least(v, top - 1)).cast("int")
    high = lambda v, top: F.greatest(F.lit(1), F.least(v, top)).cast("int")
    return [low(x1, width).alias("x1"), low(y1, height).alias("y1"), high(x2, width).alias("x2"), high(y2, height).alias("y2")]


def grid(pages: DataFrame, rows: int, cols: int, overlap: float, shift: float = 0.0) -> DataFrame:
    """rows x cols tiles of each page (page_id, width, height), grown into their neighbours by ``overlap``."""
    cells = pages.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    th, tw = F.greatest(F.lit(1), F.floor(F.col("height") / rows)), F.greatest(F.lit(1), F.floor(F.col("width") / cols))
    oy, ox = F.greatest(F.lit(4), F.floor(th * overlap)), F.greatest(F.lit(4), F.floor(tw * overlap))
    y1, x1 = F.col("r") * th + F.floor(th * shift), F.col("c") * tw
    top = F.when(F.col("r") > 0, F.greatest(F.lit(0), y1 - oy)).otherwise(y1)
    bottom = F.when(F.col("r") < rows - 1, F.least(F.col("height"), y1 + th + oy)).otherwise(y1 + th)
    left = F.when(F.col("c") > 0, F.greatest(F.lit(0), x1 - ox)).otherwise(x1)
    right = F.when(F.col("c") < cols - 1, F.least(F.col("width"), x1 + tw + ox)).otherwise(x1 + tw)
    return cells.select("page_id", "r", "c", *clip(left, top, right, bottom, F.col("width"), F.col("height")))


def expanded(boxes: DataFrame, share: float, width: int, height: int) -> DataFrame:
    dx = F.greatest(F.lit(4), F.floor((F.col("x2") - F.col("x1")) * share))
    dy = F.greatest(F.lit(4), F.floor((F.col("y2") - F.col("y1")) * share))
    keep = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return boxes.select(*keep, *clip(F.col("x1") - dx, F.col("y1") - dy, F.col("x2") + dx, F.col("y2") + dy, F.lit(width), F.lit(height)))


def seams(boxes: DataFrame, axis: str) -> DataFrame:
    """Mid-lines between neighbours by centre along ``axis``."""
    low, high = f"{axis}1", f"{axis}2"
    order = Window.partitionBy("page_id").orderBy((F.col(low) + F.col(high)) / 2, "box_id")
    following = F.lead(low).over(order)
    return boxes.withColumn("seam", F.floor((F.col(high) + following) / 2)).where("seam IS NOT NULL").select("page_id", "box_id", "seam")


def inferred_grid(boxes: DataFrame) -> DataFrame:
    """Rows and columns: gaps of more than 50 between sorted distinct centres, plus one."""

    def count(axis: str) -> DataFrame:
        centres = boxes.select("page_id", F.floor((F.col(f"{axis}1") + F.col(f"{axis}2")) / 2).alias("m")).distinct()
        gap = F.col("m") - F.lag("m").over(Window.partitionBy("page_id").orderBy("m"))
        return centres.withColumn("gap", gap).groupBy("page_id").agg((1 + F.count_if(F.col("gap") > 50)).alias(axis))

    return count("y").join(count("x"), "page_id").select("page_id", F.concat_ws("x", "y", "x").alias("grid"))


def overlap_area(a: str, b: str) -> Column:
    side = lambda k: F.greatest(F.least(f"{a}.{k}2", f"{b}.{k}2") - F.greatest(f"{a}.{k}1", f"{b}.{k}1"), F.lit(0))
    return side("x") * side("y")


def area(t: str) -> Column:
    return (F.col(f"{t}.x2") - F.col(f"{t}.x1")) * (F.col(f"{t}.y2") - F.col(f"{t}.y1"))


def suppressed(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id) of boxes that the rules drop; a box is compared with earlier ones (smaller ``box_id``) only.

    Deleted boxes still delete others, so one join of each page's boxes settles all rules.
    """
    new, old = boxes.alias("n"), boxes.alias("o")
    pairs = new.join(old, (F.col("n.page_id") == F.col("o.page_id")) & (F.col("o.box_id") < F.col("n.box_id")) & (F.col("o.x1") <= F.col("n.x2")) & (F.col("n.x1") <= F.col("o.x2")) & (F.col("o.y1") <= F.col("n.y2")) & (F.col("n.y1") <= F.col("o.y2")))
    both = overlap_area("n", "o")
    of_new, of_old = both / area("n"), both / area("o")
    hits = []
    for names, earlier, least, base, goes in SUPPRESSION:
        share = {"new": of_new, "old": of_old, "both": F.least(of_new, of_old)}[base]
        hits.append(F.when(F.col("n.name").isin(names) & F.col("o.name").isin(earlier) & (share > least), F.col(f"{goes[0]}.box_id")))
    line = F.col("n.name") == "DefaultLine"
    blocked = F.max(F.when(line & F.col("o.name").isin(LINE_BLOCKERS), 1).otherwise(0)).over(Window.partitionBy("n.page_id", "n.box_id"))
    hits.append(F.when(line & F.col("o.name").isin(LINE_BLOCKERS), F.col("n.box_id")))
    hits.append(F.when(line & (F.col("o.name") == "Main script black") & (of_old > 0.6) & (F.col("blocked") == 0), F.col("o.box_id")))
    gone = pairs.withColumn("blocked", blocked).select(F.col("n.page_id").alias("page_id"), F.explode(F.array_compact(F.array(*hits))).alias("box_id"))
    return gone.distinct()


def shape_candidates(boxes: DataFrame) -> DataFrame:
    """Touching neighbours, abnormally close ones, and boxes wider than eight heights; ``boxes``: page_id, box_id, x, y, width, height."""
    order = Window.partitionBy("page_id").orderBy("y", "x", "box_id")
    nxt = {c: F.lead(c).over(order) for c in ("x", "y", "width", "height")}
    rows = boxes.select("*", *[e.alias(f"n_{c}") for c, e in nxt.items()])
    level = F.least(F.col("y") + F.col("height"), F.col("n_y") + F.col("n_height")) - F.greatest("y", "n_y") > 0
    rows = rows.withColumn("gap", F.when(level, F.col("n_x") - F.col("x") - F.col("width")))
    rows = rows.withColumn("usual", F.coalesce(F.avg("gap").over(Window.partitionBy("page_id")), F.lit(5.0)))
    pair = F.when(F.col("gap") <= 0, "touching_components").when((F.col("gap") < F.col("usual") * 0.3) & (F.col("usual") > 2), "abnormal_kerning")
    wide = F.when((F.col("width") >= 10) & (F.col("height") > 0) & (F.col("width") / F.col("height") > 8.0), "wide_aspect_ratio")
    return rows.select("page_id", "box_id", F.explode(F.array_compact(F.array(pair, wide))).alias("reason"))


def reading_order(boxes: DataFrame, width: int) -> DataFrame:
    """Column by the largest gap between centres (over 8 % of the width), then down and across."""
    centre = (F.col("x1") + F.col("x2")) / 2
    by_centre = Window.partitionBy("page_id").orderBy("m", "box_id")
    rows = boxes.withColumn("m", centre).withColumn("gap", F.col("m") - F.lag("m").over(by_centre))
    best = F.max(F.struct(F.col("gap"), F.col("m"))).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("split", best).withColumn("column", F.when((F.col("split.gap") > 0.08 * width) & (F.col("m") >= F.col("split.m")), 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("column", "y1", "x1", "box_id"))
    return rows.select("page_id", "box_id", "column", place.alias("place"))


def per_page(rows: DataFrame, order: list, run: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``run(page_id, *columns)`` of every page as rows of ``schema``; ``columns`` are lists of the page's values by ``order``.

    ``rows``: page_id, then numeric columns.  The window brings each page together
    and in order; an Arrow batch then holds many pages, and a page may go on in the
    next ones.  A group of its own in Python would cost a page some milliseconds.
    """
    ordered = rows.withColumn("_place", F.row_number().over(Window.partitionBy("page_id").orderBy(*(order or ["page_id"]))))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def emit(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        out: list[tuple] = []
        for batch in batches:
            *columns, place = (c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)
            starts = [i for i, k in enumerate(place) if k == 1]
            if held:
                upto = starts[0] if starts else len(place)
                for own, more in zip(held, columns, strict=True):
                    own += more[:upto]
                if not starts:
                    continue
                out += run(held[0][0], *held[1:])
            for a, b in zip(starts, starts[1:]):
                out += run(columns[0][a], *[c[a:b] for c in columns[1:]])
            if starts:
                held = [c[starts[-1] :] for c in columns]
            if out:
                yield emit(out)
                out = []
        if held and (out := run(held[0][0], *held[1:])):
            yield emit(out)

    return ordered.mapInArrow(step, schema)


def _merged(distance: int):
    def run(page_id: int, *columns: list) -> list[tuple]:
        rects = [list(r) for r in zip(*columns, strict=True)]
        done = False
        while not done:
            done, out = True, []
            for r in rects:
                for o in out:
                    if r[0] - distance <= o[2] and o[0] - distance <= r[2] and r[1] - distance <= o[3] and o[1] - distance <= r[3]:
                        o[:] = [min(o[0], r[0]), min(o[1], r[1]), max(o[2], r[2]), max(o[3], r[3])]
                        done = False
                        break
                else:
                    out.append(r)
            rects = out
        return [(page_id, *r) for r in rects]

    return run


def merged_boxes(boxes: DataFrame, distance: int = 10) -> DataFrame:
    """Boxes within ``distance`` of each other merged until nothing changes; one page at a time."""
    return per_page(boxes.select("page_id", "x1", "y1", "x2", "y2"), ["y1", "x1", "x2", "y2"], _merged(distance), "page_id long, x1 int, y1 int, x2 int, y2 int")


def _unified(page_id: int, box_id: list, kind: list, x1: list, y1: list, x2: list, y2: list) -> list[tuple]:
    gone: set = set()
    size = [(c - a) * (d - b) for a, b, c, d in zip(x1, y1, x2, y2, strict=True)]
    for i, own in enumerate(kind):
        if i in gone or not own:
            continue
        for j, other in enumerate(kind):
            if other != own or i == j or j in gone:
                continue
            both = max(0, min(x2[i], x2[j]) - max(x1[i], x1[j])) * max(0, min(y2[i], y2[j]) - max(y1[i], y1[j]))
            if both / max(min(size[i], size[j]), 1) > 0.80:
                gone.add(i if size[i] < size[j] else j)
    return [(page_id, b) for i, b in enumerate(box_id) if i not in gone]


def unified(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """Of two boxes of one class where over 80 % of the smaller is covered, the smaller goes; in order, deletions count at once."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("name")), F.lit(0))  # 0: in none of the classes
    return per_page(boxes.select("page_id", "box_id", kind.alias("kind"), "x1", "y1", "x2", "y2"), ["box_id"], _unified, "page_id long, box_id long")
