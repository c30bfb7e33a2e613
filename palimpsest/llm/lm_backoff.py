"""Language-model scores with stupid backoff, computed relationally.

Texts become ids of a public tokenizer.  Three relations follow:

* counts: every n-gram of the corpus up to the model's order with its total, from
  sums made map-side, partitioned by the hash of the n-gram;
* positions: every document's n-grams of the full order, exploded to rows with
  the times they occur in it and its own counts of all shorter parts;
* scores: positions joined with the counts of each part, an expression over the
  joined columns, and the sum per document.

Frequent n-grams (at most HOT_GRAMS of them) are joined by broadcasting their
counts, single tokens likewise (a vocabulary is bounded); rows that are complete
then are summed per document before any shuffle.  Only rows with a rarer n-gram
are shuffled to the partitioned table, where no key is hot any more.

    S(c | a b) = C(abc) / C(ab)     if C(abc) > 0
               = 0.4 * S(c | b)     else
    S(c | b)   = C(bc) / C(b)       if C(bc) > 0
               = 0.4 * S(c)         else
    S(c)       = C(c) / N           if C(c) > 0
               = 0.4 / (N + 1)      else

with C and N over the rest of the corpus: a document's own occurrences are taken
off, else no n-gram would ever be unseen.  At the start of a text S begins with
the words that there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize, pick, sliced
from palimpsest.llm.token_counts import CHUNK_CHARS, fast_encoder, spliced_ids, tokenizer

BACKOFF = 0.4
ORDER = 2
ID_BITS = 20  # ids below 2**20 - 1
#: Tokens of one numpy step; a longer document is several parts, whose counts are summed by the cluster.
PART_TOKENS = 1_000_000
#: Rows of the broadcast table of frequent n-grams (16 bytes each).
HOT_GRAMS = 250_000

TOKEN_SCHEMA = "row long, doc_id long, part int, parts int, tokens int, before binary, ids binary"


def _tokens(path: str, part_tokens: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fast = tokenizer(path), fast_encoder(path)
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text"):
            out = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = x or ""
                one = fast([x])[0] if len(x) <= CHUNK_CHARS else np.concatenate([np.array(r, dtype="<u4") for r in spliced_ids(tok, x)])
                ids = np.asarray(one, dtype="<u4")
                parts = max(1, -(-len(ids) // part_tokens))
                for k in range(parts):
                    a = k * part_tokens
                    out.append((row, doc_id, k, parts, len(ids[a : a + part_tokens]), ids[max(0, a - order + 1) : a].tobytes(), ids[a : a + part_tokens].tobytes()))
                row += 1
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TOKEN_SCHEMA.split(", ")])

    return run


class Positions:
    """The tokens of several documents (or parts of them) and, at each, the ones before it.

    ``back[j]`` is the token j places earlier plus one, 0 before the text starts;
    ``doc`` the document's number; ``own`` marks tokens that are not just context.
    """

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], order: int):
        whole = [np.concatenate(t) for t in texts]
        size = np.array([len(x) for x in whole], dtype=np.int64)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        self.doc = np.repeat(np.arange(len(whole)), size)
        self.own = place >= np.repeat(np.array([len(a) for a, _ in texts], dtype=np.int64), size)
        now = (np.concatenate(whole) if whole else np.zeros(0)).astype(np.int64) + 1
        self.back = [now]
        for j in range(1, order):
            self.back.append(np.where(place >= j, np.concatenate([np.zeros(j, dtype=np.int64), now])[: len(now)], 0))


def gram_key(tokens: list[np.ndarray]) -> np.ndarray:
    """One number for the n-gram of ``tokens``, the last one first; n-grams of other lengths have other numbers."""
    return sum(t << (ID_BITS * j) for j, t in enumerate(tokens))


def _held(batches: Iterator[pa.RecordBatch], part_tokens: int) -> Iterator[list[tuple]]:
    """Lists of (row, before, ids, parts) with about ``part_tokens`` tokens together."""
    held, size = [], 0
    for batch in batches:
        names = batch.schema.names
        for row, before, ids, parts in zip(*[batch.column(names.index(c)).to_pylist() for c in ("row", "before", "ids", "parts")], strict=True):
            if held and size + len(ids) // 4 > part_tokens:
                yield held
                held, size = [], 0
            held.append((row, np.frombuffer(before, dtype="<u4"), np.frombuffer(ids, dtype="<u4"), parts))
            size += len(ids) // 4
    if held:
        yield held


def _counts(order: int, part_tokens: int, by_row: bool):
    """n-grams of all orders with their number in a run of texts, or (``by_row``) in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, part_tokens):
            for some in ([h] for h in held) if by_row else [held]:
                at = Positions([(b, i) for _, b, i, _ in some], order)
                for n in range(1, order + 1):
                    real = at.own & (at.back[n - 1] > 0)
                    key, count = np.unique(gram_key([t[real] for t in at.back[:n]]), return_counts=True)
                    columns = {"row": pa.array(np.full(len(key), some[0][0]))} if by_row else {}
                    yield pa.RecordBatch.from_pydict(columns | {"gram": pa.array(key), "n": pa.array(count)})

    return run


def _columns(order: int) -> list[str]:
    return [f"t{j}" for j in range(order)] + [f"own{j}" for j in range(1, order + 1)] + [f"ctx{j}" for j in range(2, order + 1)]


def _schema(order: int) -> str:
    return "row long, n int, size int, " + ", ".join(f"{c} int" for c in _columns(order))


def _positions(order: int, part_tokens: int):
    """Distinct n-grams of every document: n, its tokens (last first), own counts of its last j tokens and of the context before the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, part_tokens):
            at = Positions([(b, i) for _, b, i, _ in held], order)
            if not len(at.doc):
                continue
            group, own, ctx = at.doc, [], []
            for j in range(order):
                _, first, group, count = np.unique((group << (ID_BITS + 1)) | at.back[j], return_index=True, return_inverse=True, return_counts=True)
                own.append(count[group])
                if j:
                    ctx.append(np.where(at.back[j] > 0, np.concatenate([[0], own[j - 1][:-1]]), 0))
            rows = np.array([r for r, *_ in held], dtype=np.int64)
            size = np.bincount(at.doc, minlength=len(held))
            values = [rows[at.doc[first]], count, size[at.doc[first]], *[t[first] for t in at.back], *[x[first] for x in own], *[x[first] for x in ctx]]
            kinds = [pa.int64(), *[pa.int32()] * (len(values) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["row", "n", "size", *_columns(order)])

    return run


def _heads(order: int):
    """The n-grams shorter than the order that a text starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, 1):
            at = Positions([(b, i) for _, b, i, _ in held], order)
            key = [gram_key([t[m : m + 1] for t in at.back[: m + 1]]) for m in range(order - 1)]
            key = np.concatenate(key)
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(key), held[0][0])), "gram": pa.array(key), "n": pa.array(np.ones(len(key), dtype=np.int32))})

    return run


def _long_positions(parts: DataFrame, order: int, part_tokens: int) -> DataFrame:
    """:func:`_positions` of documents that are several parts: their own counts are summed and joined by the cluster."""
    own = parts.mapInArrow(_counts(order, part_tokens, True), "row long, gram long, n long").groupBy("row", "gram").agg(F.sum("n").cast("int").alias("n"))
    own = materialize(own, "own")
    size = own.where(F.col("gram") < 1 << ID_BITS).groupBy("row").agg(F.sum("n").cast("int").alias("size"))
    token = lambda j: F.shiftright("gram", ID_BITS * j).bitwiseAND((1 << ID_BITS) - 1).cast("int")
    heads = parts.where("part = 0").mapInArrow(_heads(order), "row long, gram long, n int")
    full = own.where(F.col("gram") >= 1 << (ID_BITS * (order - 1))).unionByName(heads)
    out = full.join(size, "row").select("row", "n", "size", "gram", *[token(j).alias(f"t{j}") for j in range(order)])
    for j in range(1, order + 1):
        low = (1 << (ID_BITS * j)) - 1
        out = out.withColumn("part_gram", F.col("gram").bitwiseAND(low)).join(own.toDF("row", "part_gram", f"own{j}"), ["row", "part_gram"], "left")
        if j > 1:
            out = out.drop("part_gram").withColumn("part_gram", F.shiftright(F.col("gram").bitwiseAND(low), ID_BITS)).join(own.toDF("row", "part_gram", f"ctx{j}"), ["row", "part_gram"], "left")
        out = out.drop("part_gram")
    return out.na.fill(0).select("row", "n", "size", *_columns(order))


# ---- relations -----------------------------------------------------------------------


def _key(low: int, high: int) -> Column:
    """The number of the n-gram of tokens t(high) .. t(low), t(low) last."""
    return sum((F.col(f"t{j}").cast("long") * (1 << (ID_BITS * (j - low))) for j in range(low + 1, high + 1)), F.col(f"t{low}").cast("long"))


def _lookups(order: int) -> dict[str, tuple[int, int]]:
    """Columns of corpus counts and the tokens whose n-gram they count: the last j, and the j - 1 before the last one."""
    return {f"c{j}": (0, j - 1) for j in range(1, order + 1)} | {f"d{j}": (1, j - 1) for j in range(2, order + 1)}


def log_score(order: int, n_all: Column | int) -> Column:
    """ln S of a position from its corpus counts c1.. and d2.., its own counts and the corpus size."""
    rest = F.lit(n_all) - F.col("size")
    value = BACKOFF / (rest + 1)
    for j in range(1, order + 1):
        seen = F.col(f"c{j}") - F.col(f"own{j}")
        whole = rest if j == 1 else F.col(f"d{j}") - F.col(f"ctx{j}")
        level = F.when(seen > 0, seen / whole).otherwise(value if j == 1 else BACKOFF * value)
        value = level if j == 1 else F.when(F.col(f"t{j - 1}") > 0, level).otherwise(value)
    return F.log(value)


def _backed_off(order: int) -> Column:
    """Whether the longest n-gram that the text allows is unseen elsewhere; never so for a single token."""
    out = F.lit(False)
    for j in range(2, order + 1):
        out = F.when(F.col(f"t{j - 1}") > 0, F.col(f"c{j}") <= F.col(f"own{j}")).otherwise(out)
    return out


def hot_cutoff(counts: DataFrame, most: int) -> int:
    """The least total that at most ``most`` n-grams reach."""
    steps = counts.groupBy(F.floor(F.log2("total") * 8).alias("step")).agg(F.count("*").alias("n"), F.max("total").alias("top")).collect()  # some 8 rows for each doubling
    cutoff, left = None, most
    for r in sorted(steps, key=lambda r: -r["step"]):
        if r["n"] > left:
            break
        cutoff, left = r["step"], left - r["n"]
    return math.ceil(2 ** (cutoff / 8) - 1e-9) if cutoff is not None else max((r["top"] for r in steps), default=0) + 1


def _scored(positions: DataFrame, counts: DataFrame, n_all: int, order: int, hot_grams: int) -> DataFrame:
    """(row, log_score, n_backoff, n_unseen): sums over the positions of every document."""
    single = F.col("gram") < 1 << ID_BITS
    longer = counts.where(~single)
    cutoff = hot_cutoff(longer, hot_grams)
    vocabulary, hot = counts.where(single), longer.where(F.col("total") >= cutoff)
    rows, missing = positions, F.lit(False)
    for name, (low, high) in _lookups(order).items():
        table = vocabulary if low == high else hot
        rows = rows.withColumn("gram", _key(low, high)).join(F.broadcast(table.withColumnRenamed("total", name)), "gram", "left").drop("gram")
        # A part that reaches beyond the start of the text has no count.
        missing = missing | (F.col(name).isNull() & (F.col(f"t{high}") > 0)) if low != high else missing
    score = F.col("n") * log_score(order, n_all)
    measures = {"log_score": score, "n_backoff": F.when(_backed_off(order), F.col("n")).otherwise(0).cast("long"), "n_unseen": F.when(F.col("c1") <= F.col("own1"), F.col("n")).otherwise(0).cast("long")}
    names = list(_lookups(order))
    filled = rows.select("row", "n", "size", *_columns(order), missing.alias("open"), *[F.col(c).alias(f"_{c}") for c in names], *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in names])
    # Complete rows of a document meet under one key, open ones keep their n-gram.
    key = F.when(F.col("open"), _key(0, order - 1)).otherwise(-F.col("row") - 1)
    kept = ["n", "size", *_columns(order), *[f"_{c}" for c in names]]
    sums = filled.withColumn("key", key).groupBy("row", "key").agg(*[F.sum(F.when(~F.col("open"), m)).alias(k) for k, m in measures.items()], *[F.first(c).alias(c) for c in kept])
    sums = materialize(sums, "sums")
    done = sums.where("key < 0").select("row", *measures)
    rest = sums.where("key >= 0").drop(*measures, "key")
    for name, (low, high) in _lookups(order).items():
        if low != high:
            rest = rest.withColumn("gram", _key(low, high)).join(longer.where(F.col("total") < cutoff).withColumnRenamed("total", name), "gram", "left").drop("gram")
        rest = rest.withColumn(name, F.coalesce(f"_{name}", *([name] if low != high else []), F.lit(0).cast("long")))
    rest = rest.select("row", *[m.alias(k) for k, m in measures.items()])
    return done.unionByName(rest).groupBy("row").agg(*[F.sum(k).alias(k) for k in measures])


def backoff_scores(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, part_tokens: int = PART_TOKENS, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, log_score, n_tokens, n_backoff, n_unseen.

    ``score`` is the mean of ln S over the tokens, so length does not count;
    ``log_score`` is their sum.  ``path`` is a ``tokenizers`` file, ``order`` 2 or
    3.  Null and empty texts have 0 tokens, log_score 0 and a null score.  Copies
    of a text elsewhere count as evidence for it; repeated rows are scored alike.
    An empty table gives no rows; further columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    tokens = materialize(pick(docs, doc_id=doc_id, text=text).mapInArrow(_tokens(path, part_tokens, order), TOKEN_SCHEMA), "tokens", compression="zstd")
    counts = tokens.mapInArrow(_counts(order, part_tokens, False), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("total"))
    counts = materialize(counts, "counts")
    n_all = counts.where(F.col("gram") < 1 << ID_BITS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).collect()[0]["n"]
    positions = tokens.where("parts = 1").mapInArrow(_positions(order, part_tokens), _schema(order))
    if tokens.where("parts > 1").limit(1).count():
        positions = positions.unionByName(_long_positions(tokens.where("parts > 1"), order, part_tokens))
    sums = _scored(positions, counts, n_all, order, hot_grams)
    each = tokens.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("tokens").alias("n_tokens"))
    joined = each.join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast(sums.schema[c].dataType)).alias(c)
    return joined.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("score"), zero("log_score"), "n_tokens", zero("n_backoff"), zero("n_unseen"))


def perplexity(score: float) -> float:
    """Of a mean of ln S."""
    return math.exp(-score)
