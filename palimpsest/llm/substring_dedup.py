"""Removal of passages that occur elsewhere, by relative Lempel-Ziv parsing.

Every document is factored greedily, longest match first, against reference
blocks that together hold all text which can match.  To try each block in turn
would cost documents x blocks, so text is dealt to blocks by content, and a
stretch meets exactly the one block that can hold its equal:

1. Every ``window``-word window names an anchor, the smallest hash among its
   ``anchor``-word n-grams.  Equal windows have equal anchors.  Neighbouring
   windows of one anchor form a chunk; its words are its stretch.  Each window
   of the corpus lies in the stretch of one chunk and of no other.
2. Chunks whose anchor occurs once cannot match.  Equal chunks are counted first
   and enter a block once, however many copies there are.
3. Blocks are made of the differing chunks of anchors that have several.  A
   block is indexed by the suffix order of its stretches (prefix doubling), which
   gives at every place the longest match with another place.  Chunks that occur
   once are parsed: a factor is the longest match, the next one starts behind it.
   The windows inside a factor are duplicates; windows that cross the boundary of
   factors are checked one by one against the index.
4. An anchor with very many differing chunks would make its block a hot one.  Its
   windows are counted by 128-bit hashes instead, which needs no block.

Broadcast bit filters are of bounded size and only spare rows; beyond that bound
the rows of step 2 number one for each chunk (50 bytes for some 11 windows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, bit_filter, discard, even_join, flag_known, gram_hashes, in_filter, materialize, mix, pick, positional, powers, sliced, texts_of

WINDOW = 35
ANCHOR = 8
#: Text of one numpy step, in bytes: it needs some 40 times that.
SLICE = 1_000_000
#: Stretches of a reference block, on average.
BLOCK_CHUNKS = 2_000
#: The most differing chunks of one anchor that a block takes: 2 million words, whose index needs about 200 MB and 2 s.
ANCHOR_CHUNKS = 1 << 15

CHUNK_SCHEMA = "doc_id long, text_key long, start int, windows int, anchor long, chunk long, chunk2 long"
STRETCH_SCHEMA = "doc_id long, text_key long, start int, windows int, single boolean, block long, stretch binary"
WINDOW_SCHEMA = "doc_id long, text_key long, start int, single boolean, key struct<a:long,b:long>"
RUN_SCHEMA = "doc_id long, text_key long, start int, windows int"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"

#: What a row about a chunk says: its windows are repeated; they are not, as a whole; this run of them is.
REPEATED, SINGLE, FACTOR = 0, 1, 2


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _anchors(hashes: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one document, and the place of each window's anchor.

    The anchor is the n-gram with the smallest upper half of its hash, the
    leftmost of equals, so it depends on the window's words alone.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = gram_hashes(hashes, anchor)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - anchor + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return whole, (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class _Batch:
    """Chunks of a batch of texts: start, number of windows, anchor hash."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        self.window = window
        starts, places = _anchors(self.hashes, self.words.doc, window, anchor)
        fresh = np.ones(len(starts), dtype=bool)
        fresh[1:] = (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        self.start = starts[first]
        self.size = np.diff(np.append(first, len(starts)))
        self.anchor = gram_hashes(self.hashes, anchor)[places[first]].view(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
        self.doc = self.words.doc[self.start]

    def in_text(self, start: np.ndarray, doc: np.ndarray) -> pa.Array:
        return pa.array(start - self.words.first[doc], pa.int32())


def _spans(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the word stretches [start, end)."""
    out = []
    for which, base in enumerate((0xD6E8FEB86659FD93, 0xCA4BCAA75EC3F625)):
        hashes = words.hashes(which)
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(pow(base, -1, 1 << 64), len(hashes)), out=sums[1:])
        value = (sums[end] - sums[start]) * powers(base, len(hashes) + 1)[start]
        out.append(mix(value + (end - start).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _anchor_counts(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            found, n = np.unique(_Batch(texts_of(batch.column(0)), window, anchor).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["anchor", "n"])

    return run


def _chunks(window: int, anchor: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            b = _Batch(texts_of(batch.column(2)), window, anchor)
            at = np.flatnonzero(in_filter(repeated.value, b.anchor))
            if len(at):
                start, size, doc = b.start[at], b.size[at], b.doc[at]
                one, two = _spans(b.words, start, start + size - 1 + window)
                take = pa.array(doc)
                columns = [batch.column(0).take(take), batch.column(1).take(take), b.in_text(start, doc), pa.array(size, pa.int32()), pa.array(b.anchor[at]), pa.array(one), pa.array(two)]
                yield pa.RecordBatch.from_arrays(columns, names=_names(CHUNK_SCHEMA))

    return run


# ---- the index of a block -------------------------------------------------------


def longest_matches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """At every place of ``words`` the length of the longest match that starts at another place.

    ``words`` holds stretches one after the other, ``ends`` the place behind each;
    matches end with their stretch.  Ranks of prefixes of doubled length order the
    suffixes; a place's longest match is the one with a neighbour in that order.
    """
    size = np.diff(ends, prepend=0)
    n = len(words) + len(ends)
    place = np.arange(len(words)) + np.repeat(np.arange(len(ends)), size)
    # A sign of its own behind every stretch keeps matches inside.
    rank = np.empty(n, dtype=np.int64)
    known, rank[place] = np.unique(words, return_inverse=True)
    rank[ends + np.arange(len(ends))] = len(known) + np.arange(len(ends))
    levels, width = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if width > size.max(initial=0):
            break
        behind = np.zeros(n, dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1]
        width *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(0, n - 1), dtype=np.int64)
    for level in reversed(range(len(levels))):
        x, y = a + shared, b + shared
        inside = (x < n) & (y < n)
        same = np.zeros(len(shared), dtype=bool)
        same[inside] = levels[level][x[inside]] == levels[level][y[inside]]
        shared[same] += 1 << level
    out = np.zeros(n, dtype=np.int64)
    out[b] = shared
    out[a] = np.maximum(out[a], shared)
    return out[place]


def factors(matches: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors (start, length) of the stretches [begin, end): each the longest match, or one word without any.

    All stretches advance together, one factor a step.
    """
    starts, sizes = [], []
    at, end = begins.copy(), ends.copy()
    while len(at):
        size = np.maximum(matches[at], 1)
        starts.append(at)
        sizes.append(size)
        at = at + size
        left = at < end
        at, end = at[left], end[left]
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


def duplicate_windows(words: np.ndarray, ends: np.ndarray, asked: np.ndarray, window: int) -> np.ndarray:
    """Mask of the places where a window of an ``asked`` stretch starts that starts at another place of the block too."""
    matches = longest_matches(words, ends)
    begins = ends - np.diff(ends, prepend=0)
    start, size = factors(matches, begins[asked], ends[asked])
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    long = size >= window
    np.add.at(hit, start[long], 1)
    np.add.at(hit, start[long] + size[long] - window + 1, -1)
    hit = np.cumsum(hit)[:-1] > 0
    # Windows across the boundary behind a factor.
    behind = start + size
    before = np.maximum(behind - window + 1, start)
    each = np.repeat(before, behind - before) + _count_up(behind - before)
    hit[each] |= matches[each] >= window
    return hit


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0 .. n-1 for every n in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _parse(window: int):
    def run(table: pa.Table) -> pa.Table:
        words = Words(texts_of(table.column("stretch")))
        hashes = words.hashes()
        ends = words.first[1:]
        asked = np.flatnonzero(table.column("single").to_numpy())
        hit = duplicate_windows(hashes, ends, asked, window)
        begins = words.first[:-1]
        # Places of different stretches are kept apart by the words of the last window, where none starts.
        first, last = _runs(hit)
        own = np.searchsorted(begins, first, side="right") - 1
        take = pa.array(own)
        start = pa.array(table.column("start").to_numpy()[own] + (first - begins[own]), pa.int32())
        return pa.table([table.column("doc_id").take(take), table.column("text_key").take(take), start, pa.array(last - first, pa.int32())], names=_names(RUN_SCHEMA))

    return run


def _stretches(window: int, blocks: int):
    """The words of the chunks named in ``chunks`` (start, windows, anchor, single), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words = Words(texts_of(batch.column(2)))
            asked = batch.column(3)
            n = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            start, size, anchor, single = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            doc = np.repeat(np.arange(batch.num_rows), n)
            low = words.first[doc] + start
            begin, end = words.start[low], words.end[low + size + window - 2]
            data = words.buffer
            stretch = pa.array([data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            block = (mix(anchor.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            take = pa.array(doc)
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(single), pa.array(block), stretch]
            yield pa.RecordBatch.from_arrays(columns, names=_names(STRETCH_SCHEMA))

    return run


def _windows(window: int):
    """Every window of the chunks named in ``chunks`` with its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            words = Words(texts_of(batch.column(2)))
            asked = batch.column(3)
            flat = asked.flatten()
            start, size, _, single = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            doc = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy())), size)
            each = np.repeat(start.astype(np.int64), size) + _count_up(size.astype(np.int64))
            low = words.first[doc] + each
            one, two = _spans(words, low, low + window)
            take = pa.array(doc)
            key = pa.StructArray.from_arrays([pa.array(one), pa.array(two)], names=["a", "b"])
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(each, pa.int32()), pa.array(np.repeat(single, size)), key]
            yield pa.RecordBatch.from_arrays(columns, names=_names(WINDOW_SCHEMA))

    return run


def _text_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id; rows with equal id and text have equal spans anyway."""
    return F.xxhash64(doc_id, text)


def _of_row(rows: DataFrame, lists: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their list of ``lists`` (doc_id, text_key, list) and, unshuffled, those that surely have none."""
    named = lists.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), name)
    flagged = flag_known(rows, "text_key", named, "s_key", lists.count())
    joined = flagged.where("maybe").join(named, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left").select(*rows.columns, name)
    return joined, flagged.where("NOT maybe").select(*rows.columns)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_chunks: int = BLOCK_CHUNKS, anchor_chunks: int = ANCHOR_CHUNKS) -> DataFrame:
    """(doc_id, text_key, start, windows, says): what is known of stretches of windows that may start elsewhere too.

    ``docs``: doc_id and text, text not null.  A row of the table is a document;
    equal rows are copies of each other.  ``says`` is REPEATED, SINGLE (takes back
    REPEATED of the same chunk) or FACTOR.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", _text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text")
    anchors = rows.select("text").mapInArrow(_anchor_counts(window, anchor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2").select("anchor")
    anchors = materialize(anchors, "anchors")
    repeated = sc.broadcast(bit_filter(anchors, "anchor", anchors.count()))
    discard(anchors)
    chunks = materialize(rows.mapInArrow(_chunks(window, anchor, repeated), CHUNK_SCHEMA), "chunks")
    # One row for all equal chunks, with one of them as their reference.
    groups = chunks.groupBy("anchor", "chunk", "chunk2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("at"))
    groups = materialize(groups.select("anchor", (F.col("n") == 1).alias("single"), "at.*"), "groups")
    several = materialize(groups.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_or("single").alias("asked")).where("n >= 2 AND asked").select("anchor", (F.col("n") > anchor_chunks).alias("hot")), "several")
    open_ = materialize(even_join(groups, several, "anchor", "inner", groups.count()), "open")
    said = chunks.select("doc_id", "text_key", "start", "windows", F.lit(REPEATED).alias("says")).unionByName(groups.where("single").select("doc_id", "text_key", "start", "windows", F.lit(SINGLE).alias("says")))
    found = {r["hot"]: r["n"] for r in open_.groupBy("hot").agg(F.count("*").alias("n")).collect()}
    ask = F.collect_list(F.struct("start", "windows", "anchor", "single")).alias("chunks")
    of_row = lambda hot: _of_row(rows, materialize(open_.where(F.col("hot") == hot).groupBy("doc_id", "text_key").agg(ask), "asked"), "chunks")[0].where("chunks IS NOT NULL")
    if found.get(False):
        stretches = of_row(False).mapInArrow(_stretches(window, max(1, found[False] // block_chunks)), STRETCH_SCHEMA)
        runs = stretches.groupBy("block").applyInArrow(_parse(window), RUN_SCHEMA)
        said = said.unionByName(runs.withColumn("says", F.lit(FACTOR)))
    if found.get(True):
        each = materialize(of_row(True).mapInArrow(_windows(window), WINDOW_SCHEMA), "windows")
        twice = materialize(each.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("single").alias("asked")).where("n >= 2 AND asked").select("key"), "twice")
        hits = even_join(each.where("single"), twice, "key", "left_semi", each.count()).select("doc_id", "text_key", "start", F.lit(1).alias("windows"))
        said = said.unionByName(hits.withColumn("says", F.lit(FACTOR)))
    return said


def _with_spans(rows: DataFrame, said: DataFrame) -> DataFrame:
    """``rows`` with the list ``spans`` of what is said of them; rows without do not shuffle.

    Equal rows are told the same of their chunks, which counts once.
    """
    per_row = materialize(said.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows", "says")).alias("spans")), "spans")
    joined, alone = _of_row(rows, per_row, "spans")
    return alone.withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType)).unionByName(joined)


def _removed(spans: list | None, n_words: int, window: int) -> np.ndarray | None:
    """Mask of the words that go, None if none does; a null or empty list says nothing."""
    if not spans:
        return None
    start, size, says = (np.array([x[k] for x in spans], dtype=np.int64) for k in ("start", "windows", "says"))
    # A chunk is repeated or single: the sum of both marks at its start tells.
    delta = np.zeros(n_words + 1, dtype=np.int64)
    sign = np.where(says == SINGLE, -1, 1)
    np.add.at(delta, start, sign)
    np.add.at(delta, start + size, -sign)
    starts = np.cumsum(delta[:-1]) > 0
    if not starts.any():
        return None
    reach = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + window, -1)
    return np.cumsum(reach[:-1]) > 0


def passage_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts
    anywhere else, in the same document or another.  Null text has no words;
    texts shorter than the window lose nothing; all copies of a passage go.  An
    empty table gives no rows; further columns are ignored.
    """
    base = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    said = repeated_spans(base, window, anchor, **options)
    rows = base.withColumn("text_key", _text_key(F.col("doc_id"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            out = []
            for t, spans in zip(texts_of(batch.column(1)), batch.column(2), strict=True):
                left = t.split()
                n = len(left)
                gone = _removed(spans.as_py(), n, window)
                if gone is not None:
                    left = [p for p, g in zip(left, gone.tolist(), strict=True) if not g]
                out.append((n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], names=_names(RESULT_SCHEMA))

    return _with_spans(rows, said).select("doc_id", "text", "spans").mapInArrow(run, RESULT_SCHEMA)


def drop_repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars", window: int = WINDOW, anchor: int = ANCHOR, **options) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (and ``length`` set anew).

    What is left between cuts stays as it was, white space included; the pieces
    are joined by one line break.  Documents that lose nothing stay unchanged,
    null text included; one that loses all its words leaves the table.  An empty
    table stays empty; names that clash with inner ones do no harm.
    """
    flat, names = positional(docs)
    key, body = f"_{names.index(doc_id)}", f"_{names.index(text)}"
    base = flat.select(F.col(key).alias("doc_id"), F.coalesce(F.col(body), F.lit("")).alias("text"))
    said = repeated_spans(base, window, anchor, **options)
    rows = flat.withColumn("doc_id", F.col(key)).withColumn("text_key", _text_key(F.col(key), F.coalesce(F.col(body), F.lit(""))))
    place = names.index(text)
    schema = flat.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, body, SLICE):
            n = len(names)
            old, new, keep = batch.column(place), [], []
            for t, spans in zip(old, batch.column(n), strict=True):
                words = Words([(t.as_py() or "").encode()]) if spans.is_valid else None
                gone = _removed(spans.as_py(), len(words), window) if words else None
                if gone is None:
                    new.append(t.as_py())
                    keep.append(True)
                    continue
                pieces = [words.buffer[words.start[i] : words.end[j - 1]].tobytes() for i, j in zip(*_runs(~gone), strict=True)]
                new.append(b"\n".join(pieces).decode())
                keep.append(bool(pieces))
            columns = list(batch.columns[:n])
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n]).filter(pa.array(keep))

    out = _with_spans(rows, said).select(*flat.columns, "spans").mapInArrow(run, schema)
    if length and length in names:
        at = f"_{names.index(length)}"
        out = out.withColumn(at, F.when(F.col(body).isNull(), F.col(at)).otherwise(F.length(body).cast(schema[at].dataType)))
    return out.toDF(*names)
