"""Near-duplicate classes by DartMinHash signatures and banding.

A document is a weighted set of word shingles.  Darts fall on the plane of rank
and weight of every shingle as a Poisson process that hashes fix; those below
the shingle's weight and the document's rank limit hit, each is assigned to one
of k coordinates, and a coordinate keeps its earliest dart.  Two documents share
a coordinate with the probability of their weighted Jaccard similarity, and a
document costs its length plus k ln k steps.

Runs of coordinates form bands; documents that share a band are candidates.
First every member of a band's bucket is compared with the bucket's smallest node
by the exact similarity of their whole texts, and links are merged into
components.  Then, in each bucket that holds several components, the members
outside the largest one are compared with all members.  Comparisons are made in
cells of bounded size (some asked members, some others), each by one task; a
bucket with very many members outside lets some of them go a turn, four times as
many in each turn.  At the end every pair of a bucket has been tested, is too
different in size, or lies in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, discard, even_join, flag_known, gram_hashes, materialize, mix, pick, positional, sized_join, sliced, texts_of

SHINGLE = 5
THRESHOLD = 0.8
#: Coordinates of a signature, bands drawn from them, and coordinates of a band.  At similarity 0.8 a pair shares
#: a band with probability 0.999; at 0.33, as a shared passage gives, one band in 7000 collides.
COORDINATES = 180
BANDS = 44
ROWS = 8
#: Shingles of either side of a cell, about; a document that has more is a side of its own.
CELL = 60_000
#: Members outside the largest component that a bucket compares with all others in the first turn.
OTHERS = 256
#: Links that one task merges.
SMALL = 100_000
#: Darts of one batch, about: they need 100 bytes each.
BATCH_DARTS = 500_000


def shingles(texts: list[bytes], n: int = SHINGLE, weights: str = "presence") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, weights and document numbers, in order of document.

    A text of fewer than n words is one shingle of all its words, an empty one has
    none.  Weights are 1, or with "count" the times a shingle occurs.
    """
    words = Words(texts)
    hashes = words.hashes()
    count = np.diff(words.first)
    found, owner = [], []
    for k in range(1, n + 1):
        if len(words) < k:
            break
        grams = gram_hashes(hashes, k)
        if k == n:
            at = np.flatnonzero(words.doc[: len(grams)] == words.doc[k - 1 :])
            found.append(grams[at])
            owner.append(words.doc[at])
        else:
            short = np.flatnonzero(count == k)
            found.append(mix(grams[words.first[short]] + np.uint64(k)))
            owner.append(short)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64)
    e, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((e, d))
    e, d = e[order], d[order]
    fresh = np.ones(len(e), dtype=bool)
    fresh[1:] = (e[1:] != e[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(e))).astype(float)
    return e[at], times if weights == "count" else np.ones(len(at)), d[at]


def _darts(e: np.ndarray, w: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Element number, coordinate, rank and identity of every dart below weight and rank limit."""
    who, where, when, what = [], [], [], []
    low, high, strip = 0.0, 1.0, 0
    while len(e) and (w > low).any():
        at = np.flatnonzero(w > low)
        rank = np.zeros(len(at))
        step = 0
        while len(at):
            h = mix(e[at] + np.uint64(((strip << 40) + step) * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (high - low)
            near = rank < limit[at]
            at, rank, h = at[near], rank[near], h[near]
            other = mix(h ^ np.uint64(0xD1B54A32D192ED03))
            height = low + (high - low) * (other >> np.uint64(11)).astype(float) * 2.0**-53
            hit = height < w[at]
            who.append(at[hit])
            where.append((mix(other)[hit] % np.uint64(k)).astype(np.int64))
            when.append(rank[hit])
            what.append(h[hit])
            step += 1
        low, high, strip = high, high * 2, strip + 1
    if not who:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0), np.zeros(0, dtype=np.uint64))
    return np.concatenate(who), np.concatenate(where), np.concatenate(when), np.concatenate(what)


def signatures(e: np.ndarray, w: np.ndarray, d: np.ndarray, n: int, k: int) -> np.ndarray:
    """An n x k array of dart identities; rows of documents without shingles are 0."""
    total = np.bincount(d, weights=w, minlength=n)
    limit = k * (math.log(k) + 2) / np.maximum(total, 1e-300)
    out = np.zeros((n, k), dtype=np.uint64)
    left = total > 0
    while left.any():
        own = left[d]
        ee, ww, dd = e[own], w[own], d[own]
        who, where, when, what = _darts(ee, ww, limit[dd], k)
        late_first = np.argsort(-when, kind="stable")
        row, where = dd[who][late_first], where[late_first]
        out[row, where] = what[late_first]
        have = np.zeros((n, k), dtype=bool)
        have[row, where] = True
        left &= ~have.all(axis=1)
        limit = limit * 2
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands array of 64-bit bucket keys; every band hashes its own fixed draw of ``rows`` coordinates."""
    draw = np.random.default_rng(11)
    k = signature.shape[1]
    parts = np.array([np.sort(draw.choice(k, rows, replace=False)) for _ in range(bands)])
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for j in range(rows):
        out = mix(out ^ signature[:, parts[:, j]])
    return out


def _bands(n_gram: int, weights: str, coordinates: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", rows=BATCH_DARTS // int(coordinates * (math.log(coordinates) + 2))):
            e, w, d = shingles(texts_of(batch.column(1)), n_gram, weights)
            has = np.unique(d)
            # Equal texts of a batch give one set of rows.
            has = has[np.unique(batch.column(0).to_numpy()[has], return_index=True)[1]]
            keys = band_hashes(signatures(e, w, d, batch.num_rows, coordinates)[has], bands, rows)
            nodes = batch.column(0).take(pa.array(np.repeat(has, bands)))
            sizes = np.repeat(np.bincount(d, weights=w, minlength=batch.num_rows)[has], bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), nodes, pa.array(sizes)], names=["bucket", "node", "size"])

    return run


def similarities(one: int, first: np.ndarray, ids: np.ndarray, w: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of document ``one`` with all of a cell.

    Document k has the shingles ``ids[first[k]:first[k + 1]]`` with weights ``w``
    that sum to ``total[k]``; ``own`` is a zeroed array with a place for each shingle.
    """
    mine = slice(first[one], first[one + 1])
    own[ids[mine]] = w[mine]
    both = np.add.reduceat(np.minimum(own[ids], w), first[:-1])
    own[ids[mine]] = 0
    return both / (total[one] + total - both)


def _tester(n_gram: int, weights: str, threshold: float):
    """Compare every asked member of a cell with all members of other components; a spanning set of links comes out."""

    def run(table: pa.Table) -> pa.Table:
        nodes, at, place = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        label = table.column("label").to_numpy()[at]
        asked = np.zeros(len(nodes), dtype=bool)
        asked[place[table.column("asked").to_numpy()]] = True
        e, w, d = shingles(texts_of(table.column("text").take(pa.array(at))), n_gram, weights)
        first = np.searchsorted(d, np.arange(len(nodes) + 1))
        total = np.add.reduceat(w, first[:-1])
        ids = np.unique(e, return_inverse=True)[1]
        own = np.zeros(ids.max() + 1)
        names, root = np.unique(label, return_inverse=True)
        links = []
        for i in np.flatnonzero(asked):
            low, high = np.minimum(total, total[i]), np.maximum(total, total[i])
            if not ((root != root[i]) & (low >= (threshold - 1e-9) * high)).any():
                continue
            near = similarities(i, first, ids, w, total, own) >= threshold - 1e-12
            for j in np.flatnonzero(near & (root != root[i])):
                if root[j] != root[i]:
                    links.append((label[i], label[j]))
                    root[root == root[j]] = root[i]
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _links(cells: DataFrame, texts: DataFrame, n_gram: int, weights: str, threshold: float) -> DataFrame:
    """Links (a, b) between components; ``cells``: (cell, node, label, asked), ``texts`` has one row for each node."""
    rows = cells.join(texts, "node").select("cell", "node", "label", "asked", "text")
    return rows.groupBy("cell").applyInArrow(_tester(n_gram, weights, threshold), "a long, b long").distinct()


# ---- components --------------------------------------------------------------------


def _small_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.column_stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches]
    nodes, place = np.unique(np.concatenate(held or [np.zeros((0, 2), dtype=np.int64)]), return_inverse=True)
    a, b = place.reshape(-1, 2).T
    up = np.arange(len(nodes))
    while True:
        least = np.minimum(up[a], up[b])
        now = up.copy()
        for side in (a, b, up[a], up[b]):
            np.minimum.at(now, side, least)
        now = now[now]
        if (now == up).all():
            break
        up = now
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "label"])


def components(edges: DataFrame, n_edges: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each one's component; ``edges``: (a, b), distinct.

    At most SMALL links (16 bytes each) are merged by one task; more of them by
    alternating large and small stars over the cluster, every step of which writes
    its edges to the shared folder, so no lineage grows.
    """
    if (edges.count() if n_edges is None else n_edges) <= SMALL:
        return edges.select("a", "b").coalesce(1).mapInArrow(_small_components, "node long, label long")
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = even_join(both.where("v > u"), least, "u", "inner", both.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = even_join(large, least, "u", "inner", large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "small")
        mark = tuple(small.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).collect()[0])
        discard(both)
        discard(large)
        discard(now)
        now = small
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = mark


def _relabel(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """``labels`` after components (node, label) of labels were merged."""
    merged = materialize(merged, "merged")
    if labels is None:
        return merged
    new = sized_join(labels.withColumnRenamed("label", "old"), merged.toDF("old", "label"), "old", "left", labels.count(), merged.count())
    new = new.select("node", F.coalesce("label", "old").alias("label")).unionByName(merged)
    return materialize(new.groupBy("node").agg(F.min("label").alias("label")), "labels")


# ---- buckets ------------------------------------------------------------------------


def _shared_members(texts: DataFrame, run) -> DataFrame:
    """(bucket, node, size, lead): members of buckets with several nodes, without buckets that repeat the members of another.

    ``lead`` is the member with the smallest node.
    """
    every = materialize(texts.mapInArrow(run, "bucket long, node long, size double"), "bands")
    shared = materialize(every.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket"), "buckets")
    members = materialize(sized_join(every, shared, "bucket", "left_semi", every.count(), shared.count()).distinct(), "members")
    mark = [F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.min(F.struct("node", "size")).alias("lead")]
    kept = members.groupBy("bucket").agg(*mark).groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "lead")).alias("one")).select("one.*")
    kept = materialize(kept, "kept")
    out = materialize(sized_join(members, kept, "bucket", "inner", members.count(), kept.count()).select("bucket", "node", "size", "lead"), "members")
    for done in (every, shared, members, kept):
        discard(done)
    return out


def _lead_cells(members: DataFrame, threshold: float) -> DataFrame:
    """Each lead with every member of its buckets, in cells of bounded size."""
    fit = F.least("size", "lead.size") >= (threshold - 1e-9) * F.greatest("size", "lead.size")
    pairs = materialize(members.where(F.col("node") != F.col("lead.node")).where(fit).select(F.col("lead.node").alias("first"), "node", "size").distinct(), "pairs")
    of_lead = pairs.groupBy("first").agg(F.ceil(F.sum("size") / CELL).alias("parts"))
    n = pairs.count()
    dealt = sized_join(pairs, of_lead, "first", "inner", n, n).select("first", "node", F.xxhash64("first", F.pmod(F.xxhash64("node"), "parts")).alias("cell"))
    dealt = materialize(dealt, "dealt")
    leads = dealt.select("cell", F.col("first").alias("node")).distinct()
    return dealt.select("cell", "node", F.lit(False).alias("asked")).unionByName(leads.withColumn("asked", F.lit(True))).withColumn("label", F.col("node"))


def _open_members(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, node, size, label, main, ...): all members of the buckets that hold several components.

    ``main`` is the label of the largest component there; ``others`` counts the
    members outside it, ``other_size`` and ``all_size`` are sums of their sizes.
    """
    rows = members.select("bucket", "node", "size")
    if labels is not None:
        rows = sized_join(rows, labels, "node", "left", members.count(), labels.count())
    rows = rows.select("bucket", "node", "size", F.coalesce("label", "node").alias("label") if labels is not None else F.col("node").alias("label"))
    rows = materialize(rows, "named")
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    of_bucket = parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("all_size"), F.count("*").alias("labels"), F.max_by("s", F.struct("n", "label")).alias("top_size"))
    several = of_bucket.where("labels > 1").select("bucket", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("others"), (F.col("all_size") - F.col("top_size")).alias("other_size"), "all_size")
    several = materialize(several, "several")
    out = materialize(sized_join(rows, several, "bucket", "inner", rows.count(), several.count()), "open")
    discard(rows)
    discard(several)
    return out


def _other_cells(rows: DataFrame, turn: int, cell: float) -> tuple[DataFrame, DataFrame]:
    """Cells that compare members outside the main component with all members of their bucket, and the rows left for later.

    A bucket with at most so many of them as the turn allows is done for good;
    else some are compared with all members and leave the bucket.
    """
    most = OTHERS << (2 * (turn - 1))
    share = F.ceil(F.col("others") / most)
    asked = (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("node", F.lit(turn)), share) == 0)
    left = F.ceil(F.col("other_size") / share / cell)
    right = F.ceil(F.col("all_size") / cell)
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meet = lambda mine, all_: F.explode(F.transform(up_to(all_), mine))
    key = lambda i, j: F.xxhash64("bucket", i, j)
    ask = rows.where(asked).select(meet(lambda j: key(block(left), j), right).alias("cell"), "node", "label", F.lit(True).alias("asked"))
    answer = rows.select(meet(lambda i: key(i, block(right)), left).alias("cell"), "node", "label", F.lit(False).alias("asked"))
    later = rows.where(share > 1).where(~asked).select("bucket", "node", "size")
    return ask.unionByName(answer), later


def similar_nodes(texts: DataFrame, n_gram: int = SHINGLE, threshold: float = THRESHOLD, coordinates: int = COORDINATES, bands: int = BANDS, rows: int = ROWS, weights: str = "presence") -> DataFrame:
    """(node, label) for every node that has a near duplicate; ``texts``: (node, text), rows may repeat."""
    members = _shared_members(texts, _bands(n_gram, weights, coordinates, bands, rows))
    # The texts of all members, one row for each node, are set aside once; the others are read no more.
    nodes = materialize(members.select(F.col("node").alias("need")).distinct(), "nodes")
    some = flag_known(texts.select("node", "text"), "node", nodes, "need", nodes.count()).where("maybe").select("node", "text")
    some = materialize(some.dropDuplicates(["node"]), "texts")
    discard(nodes)
    labels, turn, cells, asked = None, 0, _lead_cells(members, threshold), some
    while True:
        links = materialize(_links(cells, asked, n_gram, weights, threshold), "links")
        n_links = links.count()
        if n_links:
            labels = _relabel(labels, components(links, n_links))
        turn += 1
        open_ = _open_members(members, labels)
        discard(members)
        if not open_.count():
            break
        cells, members = _other_cells(open_, turn, CELL)
        need = materialize(open_.select("node").distinct(), "need")
        asked = sized_join(some, need, "node", "left_semi", some.count(), need.count())
    return texts.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels


def _members(rows: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (doc_id, node) with ``label``, the node itself where it has none."""
    return sized_join(rows, labels, "node", "left", n_rows, labels.count()).withColumn("label", F.coalesce("label", "node"))


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    Documents are linked if their shingle sets have a similarity of ``threshold``
    or more, or their texts are equal (null counts as empty); a class is a
    component of links, class_id its smallest doc_id (null only if all its ids
    are), class_size its rows.  ``kept`` marks the row whose id is class_id; rows
    that repeat id and text are marked alike.  Texts are told apart by a 64-bit
    hash.  An empty table gives no rows; further columns are ignored.
    """
    base = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("node", F.xxhash64("text"))
    labels = similar_nodes(base.select("node", "text"), **options)
    members = materialize(_members(base.select("doc_id", "node"), labels, base.count()).select("doc_id", "label"), "class-members")
    classes = materialize(members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size >= 2"), "classes")
    out = sized_join(members, classes, "label", "left", members.count(), classes.count())
    class_id = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, with all columns.

    Of rows with equal text the smallest id counts, of fully equal rows one stays.
    Rows that are alone in their class do not shuffle.
    """
    flat, names = positional(docs)
    key, body = f"_{names.index(doc_id)}", f"_{names.index(text)}"
    rows = flat.withColumn("node", F.xxhash64(F.coalesce(F.col(body), F.lit(""))))
    labels = similar_nodes(rows.select("node", F.coalesce(F.col(body), F.lit("")).alias("text")), **options)
    members = materialize(_members(rows.select(F.col(key).alias("doc_id"), "node"), labels, rows.count()), "class-members")
    winners = members.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("best"), F.count("*").alias("n")).where("n >= 2")
    winners = materialize(winners.select("label", F.col("best.doc_id").alias("win_id"), F.col("best.node").alias("win_node")), "winners")
    grouped = sized_join(members, winners.select("label"), "label", "left_semi", members.count(), winners.count()).select(F.col("node").alias("in_class")).distinct()
    grouped = materialize(grouped, "grouped")
    flagged = flag_known(rows, "node", grouped, "in_class", grouped.count())
    alone = flagged.where("NOT maybe").select(*flat.columns)
    maybe = flagged.where("maybe")
    single = maybe.join(grouped, F.col("node") == F.col("in_class"), "left_anti").select(*flat.columns)
    best = maybe.join(winners, (F.col("node") == F.col("win_node")) & F.col(key).eqNullSafe(F.col("win_id")), "left_semi").dropDuplicates(["node", key]).select(*flat.columns)
    return alone.unionByName(single).unionByName(best).toDF(*names)
