"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics.  Per class, mean and
covariance come from distributed sums over all labelled training rows; the
covariance is shrunk towards its diagonal and its Cholesky factor kept.  The
score is the logistic of the difference of the two Gaussian log-densities
(Mahalanobis distances by triangular solves) plus the log prior odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, covered, flag_known, gram_hashes, mix, pick, positional, sliced, texts_of

FEATURES = (
    "log_words", "symbols", "exclamations", "upper", "word_size", "distinct", "adjacent_repeats", "trigram_repeats",
    "digits", "punctuation", "lines", "pipes", "markup",
)
SHRINKAGE = 0.15
RIDGE = 0.02
FOLDS, HELD_OUT = 3, 1

SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOLS = _table(b"#*$%&<>@^~=+_\\")
_UPPER = _table(bytes(range(65, 91)))
_DIGITS = _table(b"0123456789")
_PUNCTUATION = _table(b".,;:?'\"()-")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text; an empty text has none of anything."""
    n = len(texts)
    words = Words(texts)
    hashes = words.hashes()
    count = np.diff(words.first).astype(float)
    per_word = np.maximum(count, 1)
    size = np.maximum(np.array([len(t) for t in texts], dtype=float), 1)

    def chars(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[words.buffer])])
        return (sums[words.text_start[1:]] - sums[words.text_start[:-1]]).astype(float)

    one = lambda c: chars(_table(c))
    per_doc = lambda mask: np.bincount(words.doc, weights=mask, minlength=n)
    doc_key = mix(words.doc.astype(np.uint64) + np.uint64(1))
    keys = np.sort(hashes ^ doc_key)
    order = np.argsort(hashes ^ doc_key, kind="stable")
    fresh = np.ones(len(words), dtype=bool)
    fresh[order[1:]] = keys[1:] != keys[:-1]
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    hit = np.zeros(len(words), dtype=bool)
    if len(words) >= 3:
        whole = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        grams = gram_hashes(hashes, 3)[whole] ^ doc_key[whole]
        by = np.argsort(grams, kind="stable")
        later = np.zeros(len(grams), dtype=bool)
        later[by[1:]] = grams[by[1:]] == grams[by[:-1]]
        hit = covered(whole[later], 3, len(words))
    share = lambda x: np.sqrt(x / (x + per_word))
    heaps = np.log((per_doc(fresh) + 1) / (count + 1)) + 0.12 * np.log1p(count)
    return np.column_stack([
        np.log1p(count), share(chars(_SYMBOLS)), share(one(b"!")), np.sqrt(chars(_UPPER) / size), np.log(size / per_word),
        heaps, per_doc(again) / per_word, per_doc(hit) / per_word, share(chars(_DIGITS)), share(chars(_PUNCTUATION)),
        share(one(b"\n")), share(one(b"|")), share(one(b"<>{}[]")),
    ])


@dataclass(frozen=True)
class Qda:
    """Log prior odds of class 1 and, per class, mean, Cholesky factor of the covariance and its log determinant."""

    odds: float
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    log_dets: tuple[float, float] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1 / (1 + math.exp(-self.odds)))
        density = [-0.5 * ((solve_lower(f, (x - m).T) ** 2).sum(axis=0) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def solve_lower(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of ``low @ x = y`` by forward substitution, all columns of y at once."""
    x = np.empty_like(y)
    for i in range(len(low)):
        x[i] = (y[i] - low[i, :i] @ x[:i]) / low[i, i]
    return x


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Qda:
    """``sums``: for class 0 and 1 the number of rows, the sum of vectors and of their outer products.

    With fewer than two rows in a class there is no discriminant: every text then
    gets the class share (0.5 if nothing is labelled).
    """
    counts = [sums.get(c, (0.0,))[0] for c in (0, 1)]
    odds = math.log((counts[1] + 1) / (counts[0] + 1))
    if min(counts) < 2:
        return Qda(odds, None, None, None)
    means, factors, dets = [], [], []
    moments = [sums[c] for c in (0, 1)]
    pooled = sum(m[2] for m in moments) / sum(counts) - np.outer(*[sum(m[1] for m in moments) / sum(counts)] * 2)
    scale = np.maximum(np.diag(pooled), 1e-6)
    for n, total, outer in moments:
        mean = total / n
        cov = (outer / n - np.outer(mean, mean)) * n / (n - 1)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.diag(scale)
        low = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(low)
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Qda(odds, tuple(means), tuple(factors), tuple(dets))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        x = features(texts_of(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T]], names=["doc_id", *FEATURES])


def document_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of every row; null text counts as empty, an empty table gives none."""
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_vectors, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of the rows that may have a label, without a shuffle: a bounded bit filter of the labelled ids is broadcast."""
    ids = pick(labels, label_id="doc_id").where("label_id IS NOT NULL").distinct()
    rows = pick(docs, doc_id=doc_id, text=text)
    return flag_known(rows, "doc_id", ids, "label_id", ids.count()).where("maybe").select("doc_id", "text")


def in_held_out_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per class over a partition: place 0 is the count, then vector and outer products."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)])
        for c in (0, 1):
            own = x[label == c]
            sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    k = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], k)), pa.array(np.tile(np.arange(k), 2)), pa.array(sums.ravel())], names=["label", "place", "value"])


def train(statistics: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = SHRINKAGE) -> Qda:
    """Fit on every labelled row outside the held-out fold.

    Labels other than 0 and 1, and null ids, teach nothing; a document labelled
    twice counts twice.  Only 2 x (1 + d + d*d) sums reach the driver.
    """
    d = len(FEATURES)
    known = pick(labels, label_id="doc_id", label=label).where(F.col("label").isin(0, 1) & ~in_held_out_fold(F.col("label_id"))).select("label_id", F.col("label").cast("int").alias("label"))
    rows = statistics.join(known, F.col("doc_id") == F.col("label_id")).select("label", *FEATURES)
    sums = rows.mapInArrow(_moments, "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums:
        flat[r["label"], r["place"]] = r["value"]
    return fit({c: (flat[c, 0], flat[c, 1 : 1 + d], flat[c, 1 + d :].reshape(d, d)) for c in (0, 1)}, shrinkage)


def scores(statistics: DataFrame, model: Qda) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of :func:`document_statistics`; none for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return statistics.select("doc_id", in_held_out_fold(F.col("doc_id")).alias("held_out"), *FEATURES).mapInArrow(run, SCORE_SCHEMA)


def keep_good_documents(docs: DataFrame, model: Qda, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that ``model`` scores at ``threshold`` or more; every row is judged on its own.

    Null text is judged as an empty one; an empty table stays empty.
    """
    flat, names = positional(docs)
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, f"_{place}"):
            yield batch.filter(pa.array(model.score(features(texts_of(batch.column(place)))) >= threshold))

    return flat.mapInArrow(run, flat.schema).toDF(*names)
