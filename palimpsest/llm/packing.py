"""Best-fit packing of token pieces by minimum bin slack.

Only the histogram of piece lengths decides the packing, and it has at most
``capacity`` entries whatever the corpus holds.  Bin by bin, the longest length
left is placed and a subset-sum dynamic program over the remaining lengths, kept
in the bits of one integer, finds the fullest combination that fits beside it;
the combination leaves the histogram as often as it can be formed.  Each piece
then looks up its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, partitions, pick, sliced
from palimpsest.llm.token_counts import CHUNK_CHARS, fast_encoder, spliced_ids, tokenizer

CAPACITY = 2048
END_ID = 0
ROWS_PER_SALT = 250_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
RESULT_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``.

    Bit s of ``reach`` is set if lengths looked at so far can sum to s.  Long
    lengths are tried first, and the search ends as soon as ``room`` is met.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies added together, reach before
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= (reach << (length * group)) & mask
            left -= group
            group *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for length, group, before in reversed(steps):
        if not before >> total & 1:
            total -= length * group
            out[length] = out.get(length, 0) + group
    return out


@dataclass(frozen=True)
class Plan:
    """For each length a run of rank intervals, in order: first rank, copies in a bin, first sequence, place in the bin."""

    first: np.ndarray  # of each length's intervals in the arrays below
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), dtype=np.int64)
        for one in np.unique(length):
            own = length == one
            low, high = self.first[one], self.first[one + 1]
            at[own] = low + np.searchsorted(self.rank[low:high], rank[own], side="right") - 1
        past = rank - self.rank[at]
        return self.sequence[at] + past // self.copies[at], self.offset[at] + past % self.copies[at] * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``histogram`` (length -> number of pieces) into bins of ``capacity``."""
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v}
    used = dict.fromkeys(left, 0)
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    sequences = 0
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        bins = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        bins[longest] = bins.get(longest, 0) + 1
        times = min(left[k] // c for k, c in bins.items())
        offset = 0
        for length in sorted(bins, reverse=True):
            copies = bins[length]
            rows[length].append((used[length], copies, sequences, offset))
            offset += copies * length
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        sequences += times
    flat = np.array([x for per in rows for x in per], dtype=np.int64).reshape(-1, 4)
    first = np.concatenate([[0], np.cumsum([len(per) for per in rows])])
    return Plan(first, flat[:, 0].copy(), flat[:, 1].copy(), flat[:, 2].copy(), flat[:, 3].copy(), sequences)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces: all full but the first, which takes what is over."""
    over = len(ids) % capacity or capacity
    starts = [0, *range(over, len(ids), capacity)]
    return [(a, ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def _pieces(path: str, capacity: int, end_id: int, salts: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, fast = tokenizer(path), fast_encoder(path)
        dealt = TaskContext.get().partitionId() * 7919
        for batch in sliced(batches, "text", 1_000_000):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            short = [x for x in texts if len(x) <= CHUNK_CHARS]
            encoded = iter(fast(short))
            out: list[tuple] = []
            for i, text in enumerate(texts):
                runs = [next(encoded)] if len(text) <= CHUNK_CHARS else spliced_ids(tok, text)
                ids = np.concatenate([*[np.array(r, dtype="<u4") for r in runs], np.array([end_id], dtype="<u4")])
                for k, (start, piece) in enumerate(cut(ids, capacity)):
                    dealt += 1
                    out.append((i, k, start, len(piece), zlib.crc32(piece.tobytes()), dealt % salts, piece if with_ids else None))
            columns = list(zip(*out, strict=True))
            arrays = [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *[pa.array(columns[j], pa.int64()) for j in (2, 3, 4)], pa.array(columns[5], pa.int32())]
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in columns[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there (``ids`` too, if asked for).

    Every document is followed by ``end_id``, so null and empty texts give one
    piece of one token; repeated rows and ids are packed each on its own.
    Only documents longer than ``capacity`` are cut.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    salts = max(2 * partitions(spark), docs.count() // ROWS_PER_SALT)
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    # Written once: ranks and lengths are then those of one and the same encoding.
    pieces = materialize(pick(docs, doc_id=doc_id, text=text).mapInArrow(_pieces(path, capacity, end_id, salts, with_ids), schema), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    packed = spark.sparkContext.broadcast(plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("within", within).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within") - 1)
    names = [x.split()[0] for x in RESULT_SCHEMA.split(", ")][:5] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            sequence, offset = packed.value.place(get("length").to_numpy(), get("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[get(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = RESULT_SCHEMA if not with_ids else RESULT_SCHEMA.replace("sequence_id", "ids array<int>, sequence_id")
    return ranked.select(*names, "rank").mapInArrow(run, out)
