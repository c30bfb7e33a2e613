"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over all words of a
batch of texts, give the share of a text's characters that lie inside repeated
n-grams and repeated lines; a text fails if one of the shares is too large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import Words, covered, gram_hashes, mix, pick, sliced, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_GRAM = 3
#: n-gram length -> largest share of word characters inside n-grams that occur twice or more, later occurrences counted.
GRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in GRAM_LIMITS)
)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries whose key occurs twice or more, and of those that are not a key's first."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    n = len(texts)
    words = Words(texts)
    hashes = words.hashes()
    chars = np.concatenate([[0], np.cumsum((words.buffer & 0xC0) != 0x80)])  # code points before each byte
    sizes = chars[words.end] - chars[words.start]
    per_doc = lambda weights: np.bincount(words.doc, weights=weights, minlength=n)
    out = {"n_words": np.diff(words.first), "word_chars": per_doc(sizes).astype(np.int64)}
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[words.buffer])])
    out["n_symbols"] = symbols[words.text_start[1:]] - symbols[words.text_start[:-1]]
    doc_key = mix(words.doc.astype(np.uint64) + np.uint64(1))
    shares = {}
    for k in (BASE_GRAM, *GRAM_LIMITS):
        if len(words) < k:
            hit = np.zeros(len(words), dtype=bool)
        else:
            whole = np.flatnonzero(words.doc[: len(words) - k + 1] == words.doc[k - 1 :])
            keys = gram_hashes(hashes, k)[whole] ^ doc_key[whole]
            twice, later = _repeats(keys)
            hit = covered(whole[twice if k == BASE_GRAM else later], k, len(words))
        if k == BASE_GRAM:
            out["n_repeat_words"] = per_doc(hit).astype(np.int64)
        else:
            shares[f"dup_{k}gram_share"] = per_doc(np.where(hit, sizes, 0)) / np.maximum(out["word_chars"], 1)
    dup_lines, dup_chars = np.zeros(n, dtype=np.int64), np.zeros(n)
    for i, text in enumerate(texts):
        if b"\n" not in text:
            continue
        seen = set()
        for line in text.split(b"\n"):
            if line in seen:
                if parts := line.split():
                    dup_lines[i] += 1
                    dup_chars[i] += sum(len(x.decode()) for x in parts)
            else:
                seen.add(line)
    out["n_dup_lines"] = dup_lines
    out["dup_line_share"] = dup_chars / np.maximum(out["word_chars"], 1)
    return out | shares


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        m = _measure(texts_of(batch.column(1)))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        bad = m["dup_line_share"] > LINE_LIMIT
        for k, limit in GRAM_LIMITS.items():
            bad |= m[f"dup_{k}gram_share"] > limit
        m |= {"base_failed": failed, "kept": ~failed & ~bad}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m[x]) for x in names[1:]]], names=names)


def repetition_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` with its counts, shares and verdict.

    Null and empty texts have no words and fail the base rules.  Rows with equal
    ids or texts are judged each on its own.  Texts are measured whole; a batch
    holds about 4 MB of text, or one longer text.
    """
    return pick(docs, doc_id=doc_id, text=text).mapInArrow(_rules, SCHEMA)
