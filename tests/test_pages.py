"""Rules by page, many pages to one Arrow batch."""

import numpy as np

from palimpsest import registry
from palimpsest.operators import geometry as G
from palimpsest.plans import layout


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_pages_go_on_in_later_batches(spark):
    """A page is given whole and once, however batches cut it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(p, b) for p in range(40) for b in range(p % 9 + 1)]
        got = G.per_page(spark.createDataFrame(rows, "page_id long, box_id long"), ["box_id"], lambda page, own: [(page, len(own))] if own == list(range(len(own))) else [(page, -1)], "page_id long, n int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(p, p % 9 + 1) for p in range(40)]


def test_block_rects_takes_many_pages_at_once(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["W12_block_rects"](spark, sf))


def test_touching_sets_of_a_page_with_many_boxes():
    """Both ways to walk a set of boxes find the same sets."""
    rng = np.random.default_rng(1)
    low = rng.integers(0, 300, (200, 2))
    boxes = np.concatenate([low, low + rng.integers(1, 12, (200, 2))], axis=1)
    sets = lambda found: sorted(sorted(map(tuple, members)) for members in found)
    few, many = sets(layout._touching_few([tuple(r) for r in boxes.tolist()])), sets(layout._touching_sets(boxes))
    assert few == many and 1 < len(few) < 200


def test_region_blocks_takes_many_pages_at_once(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["W13_region_blocks"](spark, sf))


def test_W11_merged_boxes_takes_many_pages_at_once(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["W10_W11_merged_boxes"](spark, sf))


def test_P38_unified_takes_many_pages_at_once(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["J13_P38_unified"](spark, sf))


def test_segmented_regions_takes_many_pages_at_once(spark, sf):
    assert "FlatMapGroupsInPandas" not in plan_of(registry.queries()["J16_segmented_regions"](spark, sf))


def test_regions_in_columns_leave_pages_without_columns_out(spark, sf):
    assert not {"FlatMapGroupsInPandas", "MapInArrow"} & set(plan_of(registry.queries()["J16_regions_in_columns"](spark, sf)).split())
