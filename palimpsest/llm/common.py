"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATORS = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: 10,000 rows of text, the only bound by default below 64 MB, are held several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    now = int(size) << 10 * " kmgt".index(unit or " ")
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``alias=name`` pairs by exact name.

    Columns are addressed by position, so tables that hold further columns whose
    names differ in case only, or repeat a name (the first one counts), work too.
    """
    bounded_batches(df.sparkSession)
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(name)}").alias(alias) for alias, name in columns.items()])


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with columns ``_0 .. _n`` and the names to restore afterwards."""
    bounded_batches(df.sparkSession)
    names = df.columns
    return df.toDF(*[f"_{i}" for i in range(len(names))]), names


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder of the context is
    set, and driver and executors are one process, does this set a folder of its own.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        known = sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(known)
    return known


def materialize(df: DataFrame, label: str = "t", compression: str = "snappy", by: str | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    ``by``: an int column of few values that files are laid out by; ``onto``: a
    table of this function that ``df`` is added to.
    """
    spark = df.sparkSession
    path = onto._palimpsest_path if onto is not None else f"{checkpoint_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path, compression=compression, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later result reads."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes, and they ``rows`` rows, at most.

    A single longer text is one batch of its own; no text is ever cut.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()), dtype=np.int64, count=n)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


# ---- vectorised word hashing -------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE_CODES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)
_GRAM_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_POWERS: dict[int, np.ndarray] = {}
#: Longer tables (8 bytes an entry, some ten bases) are made anew each time.
KEPT_POWERS = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << max(0, (n - 1)).bit_length())
        steps = np.full(size, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts, as arrays.

    ``start``/``end`` are byte places in ``buffer`` (the texts, each followed by
    one newline), ``doc`` the text's number, ``first`` the place of each text's
    first word in the word arrays (one more entry than texts).
    """

    def __init__(self, texts: list[bytes]):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~_IS_SEPARATOR[self.buffer]
        edges = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edges == 1)
        self.end = np.flatnonzero(edges == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One 64-bit hash for each word; ``which`` picks one of two functions."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], size)
        code = _BYTE_CODES[which][self.buffer[self._inside]]
        code *= powers(int(_BASES[which]), int(size.max()))[place]
        return mix(np.add.reduceat(code, total[:-1]) + size.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Rolling hashes of all n-word windows: one for each start, len(words)-n+1 of them."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    base = _GRAM_BASES[which]
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(inverse, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(base, len(words) - n + 1))


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask of ``size`` places covered by [s, s+width) for any s in ``starts``."""
    delta = np.zeros(size + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, size), -1)
    return np.cumsum(delta[:-1]) > 0


def next_power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def require_file(path: str) -> str:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return path


# ---- joins that stay even where a key is hot ----------------------------------

HOT_KEYS = 1_000


def hot_threshold(rows: int) -> int:
    """Keys with at least so many of ``rows`` rows number HOT_KEYS at most."""
    return max(64, math.ceil(rows / HOT_KEYS))


def even_join(rows: DataFrame, table: DataFrame, key: str, how: str, n_rows: int) -> DataFrame:
    """Join ``rows`` with ``table``, which has one narrow row for a key; ``how``: inner, left_semi or left_anti.

    Keys with very many rows are joined by broadcasting their (at most
    HOT_KEYS) table rows, all others by a shuffle.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_threshold(n_rows)).select(key)
    # A made-up key is always among them, so the plan has one shape whether keys are hot or not.
    kind = rows.schema[key].dataType
    zero = F.lit(0).cast(kind) if not isinstance(kind, StructType) else F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in kind.fields])
    hot = hot.unionByName(rows.sparkSession.range(1).select(zero.alias(key)))
    cold_rows = rows.join(F.broadcast(hot), key, "left_anti")
    hot_rows = rows.join(F.broadcast(hot), key, "left_semi")
    hot_table = F.broadcast(table.join(F.broadcast(hot), key, "left_semi"))
    return cold_rows.join(table, key, how).unionByName(hot_rows.join(hot_table, key, how))


#: Rows of a table of two or three numbers that may be broadcast (a few MB).
BROADCAST_ROWS = 250_000


def sized_join(rows: DataFrame, table: DataFrame, key: str, how: str, n_rows: int, n_table: int) -> DataFrame:
    """:func:`even_join`, but a ``table`` that was counted to have few rows is broadcast whole."""
    if n_table <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    return even_join(rows, table, key, how, n_rows)


# ---- bounded Bloom filters for Python stages -----------------------------------

FILTER_BITS = 1 << 27
BUCKET_BITS = 32768


def bit_filter(values: DataFrame, column: str, count: int, max_bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array with bit ``v mod bits`` set for each value: at most max_bits / 8 bytes (16 MiB) reach the driver.

    Full filters let more values through; what is let through is always checked again.
    """
    bits = max(BUCKET_BITS, min(max_bits, next_power_of_two(16 * count)))
    place = F.pmod(F.col(column), F.lit(bits))
    rows = values.select(place.alias("place")).groupBy(F.expr(f"place div {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(place % {BUCKET_BITS})").alias("bitmap")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[r["bucket"] * BUCKET_BITS // 8 : (r["bucket"] + 1) * BUCKET_BITS // 8] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return out


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mask of the (u)int64 ``values`` that the filter lets through."""
    place = values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def flag_known(rows: DataFrame, column: str, values: DataFrame, value: str, count: int, max_bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``maybe``: false proves that the long ``column`` is none of ``values``; a bounded bitmap is broadcast."""
    bits = max(BUCKET_BITS, min(max_bits, next_power_of_two(16 * count)))
    place = F.pmod(F.col(value), F.lit(bits))
    maps = values.select(place.alias("place")).groupBy(F.expr(f"place div {BUCKET_BITS}").alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(place % {BUCKET_BITS})").alias("_bitmap"))
    out = rows.withColumn("_place", F.pmod(F.col(column), F.lit(bits))).join(F.broadcast(maps), F.expr(f"_place div {BUCKET_BITS} = _bucket"), "left")
    byte = f"cast(conv(hex(substring(_bitmap, cast((_place % {BUCKET_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    return out.withColumn("maybe", F.coalesce(F.expr(f"({byte} & shiftleft(1, cast(_place % 8 as int))) <> 0"), F.lit(False))).drop("_place", "_bucket", "_bitmap")
