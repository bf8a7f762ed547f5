"""The corpus pipeline: its stages in order, each one operator of ``salesflow.llm``.

``run`` writes the result of every stage as Parquet to the scratch folder and rereads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm import decontamination, mixing, near_dedup, token_files, toxicity
from salesflow.llm.tables import table
from salesflow.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not call toxic."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document by id of every near-duplicate class; rows that repeat an id with other texts are documents of their own."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = materialize(decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id")).distinct())
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak_id")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the rows of the written files, in file order, are the schedule."""
    slots = mixing.schedule(docs).groupBy("doc_id").agg(F.min("slot").alias("slot"))
    slots = materialize(slots.select(F.col("doc_id").alias("slot_id"), "slot")).hint("shuffle_hash")
    order = ["slot", "source", "doc_id"]
    placed = docs.join(slots, F.col("doc_id").eqNullSafe(F.col("slot_id"))).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix (the row order of the previous stage's files), and what is read back."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")   # as a number: there may be more than 100,000 files
    return token_files.round_trip(docs, order=[part, F.col("_metadata.row_index")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
ORACLE_SQL = None   # a fitted model and a tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
