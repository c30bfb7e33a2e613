"""Retry plans of a page: the rules on one page are those on rows, and tiles are not shuffled."""

from palimpsest import registry
from palimpsest.operators import geometry as G
from palimpsest.operators import retry as R
from palimpsest.plans import layout
from tests.compare import connection, rows

SIZES = [(600, 800), (1499, 1499), (701, 977), (3, 2), (1, 1)]
#: A page of two columns, one of a single box, one with a box behind another, one with slivers.
BOXES = {0: [(1, 0, 0, 300, 400), (2, 310, 0, 600, 400), (3, 0, 420, 300, 800), (4, 310, 420, 600, 800)], 1: [(1, 5, 5, 90, 90)], 2: [(1, 10, 10, 500, 500), (2, 20, 20, 480, 490), (3, 20, 20, 700, 900)], 3: [(2, 0, 0, 3, 1), (1, 1, 0, 3, 2)]}


def as_rows(spark, boxes):
    return spark.createDataFrame([(p, *b) for p, own in boxes.items() for b in own], "page_id long, box_id long, x1 int, y1 int, x2 int, y2 int")


def by_page(df):
    out = {}
    for row in df.select("page_id", "x1", "y1", "x2", "y2").collect():
        out.setdefault(row[0], []).append(tuple(row[1:]))
    return {k: sorted(v) for k, v in out.items()}


def sizes(spark, of=None):
    return spark.createDataFrame(of or [(p, *z) for p, z in enumerate(SIZES)], "page_id long, width int, height int")


def plain(tiles):
    return sorted(t[1:] for t in tiles)


def test_retry_shuffles_sizes_and_boxes_only(spark, sf):
    plan = registry.queries()["M13_retry_strategy"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan


def test_grids_of_a_page_are_those_of_rows(spark):
    for rows, cols, shift in [*((r, c, 0.0) for r, c in R.GRIDS), (3, 1, 0.33)]:
        assert by_page(G.grid(sizes(spark), rows, cols, 0.15, shift)) == {p: plain(R.grid_boxes(z, rows, cols, 0.15, shift)) for p, z in enumerate(SIZES)}


def test_bands_of_a_page_are_those_of_rows(spark, sf):
    found = {p: plain(R.band_boxes(own, [SIZES[p]])) for p, own in BOXES.items()}
    assert by_page(R.seam_bands(sizes(spark), as_rows(spark, BOXES))) == {p: t for p, t in found.items() if t} and found[0] and not found[1]
    before = layout.plans_before(spark, sf).where("page_id < 300")
    pages = {r[0]: (r[1], r[2]) for r in layout.pages(spark, sf).where("page_id < 300").collect()}
    own = {}
    for r in before.select("page_id", "box_id", "x1", "y1", "x2", "y2").collect():
        own.setdefault(r[0], []).append(tuple(r[1:]))
    assert by_page(R.seam_bands(layout.pages(spark, sf).where("page_id < 300"), before)) == {p: plain(t) for p, b in own.items() if (t := R.band_boxes(b, [pages[p]]))}


def test_signature_of_a_page_is_that_of_rows(spark):
    assert {r.page_id: r.signature for r in R.signatures(as_rows(spark, BOXES)).collect()} == {p: R.hashed(b) for p, b in BOXES.items()}


def test_the_first_plan_that_differs_is_taken(monkeypatch):
    size = (600, 800)
    assert R.first_changed(BOXES[0], [size])[::2] == ("grid_shift", 4)
    assert R.first_changed(R.grid_boxes(size, 2, 2, 0.15), [size])[::2] == ("grid_shift", 6)
    monkeypatch.setattr(R, "GRIDS", [])
    offset = R.grid_boxes(size, 3, 1, 0.15, 0.33)
    assert R.first_changed(offset, [size]) == ("seam_band_crop", R.hashed(R.band_boxes(offset, [size])), len(R.band_boxes(offset, [size])))
    monkeypatch.setattr(R, "band_boxes", lambda boxes, sizes: [])
    assert R.first_changed(offset, [size]) == ("expand_overlap", R.hashed(R.wider_boxes(offset, size, 0.22)), 3)
    monkeypatch.setattr(R, "wider_boxes", lambda boxes, size, expand: boxes)
    assert R.first_changed(offset, [size]) is None


def test_repeated_and_missing_pages_follow_the_sql(spark, sf, tmp_path):
    """Two sizes for a page, pages without boxes, boxes without pages, no part, no id."""
    con = connection(sf)
    for table, change in (
        ("orders", "SELECT * FROM orders UNION ALL SELECT * REPLACE (o_custkey + 7 AS o_custkey) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM orders WHERE o_orderkey < 5"),
        ("lineitem", "SELECT * REPLACE (CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_orderkey = 5 THEN 1000001 WHEN l_orderkey = 8 THEN NULL ELSE l_orderkey END AS l_orderkey) FROM lineitem"),
    ):
        con.sql(f"COPY ({change}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = registry.queries()["M13_retry_strategy"](spark, str(tmp_path))
    found = con.sql(registry.oracle_sql()["M13_retry_strategy"])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
