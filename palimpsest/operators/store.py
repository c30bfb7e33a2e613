"""Scans, sinks and keyed writes of the store, as DataFrame operations.

Parquet has no update in place: an update is a later row, and the state is the
latest row of each key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(table: DataFrame, where: dict | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that equal every given value (None: no condition), ordered, the first ``limit``."""
    for name, value in (where or {}).items():
        if value is not None:
            table = table.where(F.col(name) == value)
    if order:
        table = table.orderBy(*order)
    return table if limit is None else table.limit(limit)


def table_view(table: DataFrame) -> DataFrame:
    """Each row as one JSON object with its columns by name."""
    return table.select(F.to_json(F.struct(*table.columns)).alias("row"))


def first_by_key(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(table: DataFrame, key: str, created: str, updated: str, tie: str) -> DataFrame:
    """The latest row of each key, with the earliest creation time."""
    names = [c for c in table.columns if c not in (key, created)]
    latest = F.max_by(F.struct(*names), F.struct(updated, tie))
    return table.groupBy(key).agg(F.min(created).alias(created), latest.alias("_row")).select(key, created, *[F.col("_row")[c].alias(c) for c in names])


def last_values(table: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per key and column the last value that is not null: partial updates applied in order."""
    return table.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def without(table: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """The table after a delete of all rows whose key is in ``doomed``."""
    return table.join(doomed.select(key).distinct(), key, "left_anti")


def cache_status(queries: DataFrame, cache: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """miss, hit, empty-hit or expired: only empty entries expire."""
    joined = queries.join(cache, "cache_key", "left")
    old = F.col("created_at") < now - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {max_age_hours * 3600})")
    return joined.withColumn("status", F.when(F.col("created_at").isNull(), "miss").when(F.col("n_results") > 0, "hit").when(old, "expired").otherwise("empty-hit"))


def best_attempt(attempts: DataFrame, key: str, passed: str, order: str, columns: list[str]) -> DataFrame:
    """The latest passing attempt of each run, else its latest."""
    return attempts.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(passed, order)).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in columns])


def append_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``); a temporary one where both are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{root}/{kind}/{uuid.uuid4().hex}"


def appended(batches: list[DataFrame], kind: str, as_json: bool = False) -> DataFrame:
    """The table that is there after the batches were appended one by one."""
    spark, schema = batches[0].sparkSession, batches[0].schema
    path = shared_folder(spark, kind)
    for rows in batches:
        (append_jsonl if as_json else append_parquet)(rows, path)
    reader = spark.read.schema(schema)
    return reader.json(path) if as_json else reader.parquet(path)
