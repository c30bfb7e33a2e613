"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.  The quality model
learns from the labelled rows of the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, near_dedup, packing, quality_qda, substring_dedup
from palimpsest.llm.common import documents, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go.

    Only rows that may have a label are measured for the training; every row is
    judged.  Null text is judged as empty; an empty table stays empty; columns are
    addressed by place, so clashing names do no harm.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    statistics = materialize(quality_qda.document_statistics(quality_qda.labelled(docs, labels)), "statistics")
    return quality_qda.keep_good_documents(docs, quality_qda.train(statistics, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, null ids sort lowest.

    An empty table stays empty; further columns come along whatever their names.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the smallest doc_id stays; empty and null texts are equal, and near nothing else.

    An empty table stays empty; further columns come along whatever their names.
    """
    return near_dedup.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur elsewhere are cut out; n_chars follows.

    Null texts stay null, a text that loses all its words leaves, an empty table
    stays empty; further columns come along whatever their names.
    """
    return substring_dedup.drop_repeated_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; null and empty texts give a piece of one token.

    An empty table gives no rows; further columns are ignored.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the discriminant nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
