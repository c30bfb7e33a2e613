"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Documents are read once for a narrow table of prints: id, SHA-256, and the place
of the text's hash in a filter of BITS_PER_ROW bits a row.  Pass 1 finds the
places that two or more rows share and keeps them as bitmaps; pass 2 tests every
row against them.  Equal texts have equal places, so a row that fails the test is
unique and passes straight through; only the others shuffle and are grouped by
SHA-256.  False positives cost a shuffle of a narrow row, never a wrong result.

The filter grows with the rows and has no largest size: it is cut into ranges of
at most ``range_bits`` bits (32 MiB by default), the prints are written by range,
and each range is tested against its own broadcast bitmaps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BUCKET_BITS, discard, flag_known, materialize, next_power_of_two, pick, positional

BITS_PER_ROW = 32
RANGE_BITS = 1 << 28
RUN = 65536
HOT_GROUPS = 10_000


def _prints(rows: DataFrame, count: int, range_bits: int) -> tuple[DataFrame, int]:
    """(doc_id, sha, place, part) of ``rows`` (doc_id, text), written by part, and the number of parts.

    ``place`` counts from the start of its part of the filter.
    """
    bits = max(BUCKET_BITS, next_power_of_two(count * BITS_PER_ROW))
    parts = max(1, bits // range_bits)
    place = F.pmod(F.xxhash64("text"), F.lit(bits))
    prints = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), (place % (bits // parts)).alias("place"), F.floor(place / (bits // parts)).cast("int").alias("part"))
    return materialize(prints, "prints", by="part"), parts


def _tested(prints: DataFrame, parts: int) -> DataFrame:
    """``prints`` with ``maybe``: false proves that no other row has the same text."""
    shared = prints.groupBy("part", "place").agg(F.count("*").alias("n")).where("n >= 2")
    maps = shared.groupBy("part", F.expr(f"place div {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(place % {BUCKET_BITS})").alias("bitmap"))
    maps = materialize(maps, "filter", by="part")
    byte = f"cast(conv(hex(substring(bitmap, cast((place % {BUCKET_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"({byte} & shiftleft(1, cast(place % 8 as int))) <> 0"), F.lit(False))
    out = None
    for part in range(parts):
        own = maps.where(F.col("part") == part).drop("part")
        tested = prints.where(F.col("part") == part).join(F.broadcast(own), F.expr(f"place div {BUCKET_BITS} = bucket"), "left").select("doc_id", "sha", hit.alias("maybe"))
        out = materialize(tested, "tested", onto=out)
    discard(maps)
    return out


def _groups(tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Possible copies as (sha, doc_id, rows), equal rows as one, and (sha, keep_id, group_size) of every text among them."""
    # A (text, id) pair first, with its number of equal rows: hot texts meet as partial sums only.
    pairs = materialize(tested.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("rows")), "pairs")
    return pairs, materialize(pairs.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size")), "groups")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bits: int = RANGE_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; of equal texts the row with the largest doc_id
    stays (null ids sort lowest; if all are null, keep_id is null).  If whole
    rows repeat (same id, same text), one of them is kept.  An empty table gives
    an empty result; further columns are ignored.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    count = rows.count()
    tested = _tested(*_prints(rows, count, range_bits))
    hex_ = F.lower(F.hex("sha")).alias("text_sha256")
    alone = tested.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_)
    pairs, groups = _groups(tested)
    # Groups of at least count / HOT_GROUPS rows number HOT_GROUPS at most: those are broadcast, so no key is hot in the join.
    hot_size = max(32, math.ceil(count / HOT_GROUPS))
    hot = F.broadcast(groups.where(F.col("group_size") >= hot_size))
    cold = groups.where(F.col("group_size") < hot_size)
    joined = pairs.join(hot, "sha").unionByName(pairs.join(hot.select("sha"), "sha", "left_anti").join(cold, "sha"))
    runs = joined.withColumn("run", F.explode(F.expr(f"sequence(0L, (rows - 1) div {RUN})")))
    each = runs.withColumn("place", F.explode(F.expr(f"sequence(run * {RUN}, least(rows, (run + 1) * {RUN}) - 1)")))
    copies = each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 0)).alias("kept"), hex_)
    return alone.unionByName(copies)


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bits: int = RANGE_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by the rule of :func:`exact_duplicates`.

    Groups are found on the narrow table; rows with a text that occurs once never
    shuffle, as a bounded bit filter of the repeated texts is broadcast (if more
    texts repeat than it can tell apart, rows are shuffled once at worst).  Of a
    group's rows, those that are not its winner leave in a semi-join on (hash, id).
    """
    flat, names = positional(docs)
    key, body = f"_{names.index(doc_id)}", f"_{names.index(text)}"
    whole = F.coalesce(F.col(body), F.lit(""))
    rows = flat.select(F.col(key).alias("doc_id"), whole.alias("text"))
    _, groups = _groups(_tested(*_prints(rows, flat.count(), range_bits)))
    winners = groups.where("group_size >= 2").select("sha", "keep_id", F.expr("conv(hex(substring(sha, 1, 7)), 16, 10)").cast("long").alias("mark"))
    winners = materialize(winners, "winners")
    marked = flat.withColumn("sha256", F.unhex(F.sha2(whole, 256))).withColumn("own_mark", F.expr("conv(hex(substring(sha256, 1, 7)), 16, 10)").cast("long"))
    flagged = flag_known(marked, "own_mark", winners, "mark", winners.count())
    maybe = flagged.where("maybe")
    single = maybe.join(winners, F.col("sha256") == F.col("sha"), "left_anti")
    best = maybe.join(winners, (F.col("sha256") == F.col("sha")) & F.col(key).eqNullSafe(F.col("keep_id")), "left_semi").dropDuplicates(["sha256", key])
    return flagged.where(~F.col("maybe")).select(*flat.columns).unionByName(single.select(*flat.columns)).unionByName(best.select(*flat.columns)).toDF(*names)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
