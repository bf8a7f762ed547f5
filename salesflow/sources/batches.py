"""Appending batches so that a repeated append replaces its own batch instead of doubling its rows.

    <path>/data/batch=id-<batch>/attempt=try-<random>/order_year=<y>/*.parquet
    <path>/commits/*.parquet                one row per finished attempt: batch, attempt, committed_at

An attempt counts once its commit row is there, and only the last committed attempt of a batch is read. A write that dies
half-way, or a task that runs twice, leaves files that nothing refers to.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesflow.schema import CLEAN_SCHEMA
from salesflow.sources.tables import with_date_parts, write_by_year

_ID = "id-"
_COMMITS = "batch string, attempt string, committed_at timestamp"


def write_attempt(df: DataFrame, path: str, batch: str) -> str:
    """Write the rows of a batch, one folder per year, and return the attempt; it is not read before it is committed."""
    attempt = f"try-{uuid.uuid4().hex}"   # folder names that Spark cannot take for numbers or dates
    # batch and attempt are folders only: as columns they would be shuffled and sorted with every row
    write_by_year(df, f"{path}/data/batch={_folder(_ID + batch)}/attempt={attempt}", mode="append")
    return attempt


def _folder(value: str) -> str:
    """A partition value as Spark names its folder: what a path cannot hold as %XX."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def commit_attempt(spark: SparkSession, path: str, batch: str, attempt: str) -> None:
    """Make an attempt the one that its batch is read from. The row is one file, so it is there as a whole or not at all."""
    row = spark.range(1).select(F.lit(_ID + batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Append a batch, or replace it if it was appended before, whichever years it had then."""
    commit_attempt(df.sparkSession, path, batch, write_attempt(df, path, batch))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The valid attempt of every batch."""
    try:
        rows = spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _COMMITS)
    return rows.groupBy("batch").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))


def load_batches(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """The rows of all committed batches with their date parts and ``batch``; ``years`` prunes folders, and so do the valid attempts. A path
    without data gives an empty table."""
    try:
        rows = spark.read.parquet(f"{path}/data")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = spark.createDataFrame([], StructType([*CLEAN_SCHEMA.fields]).add("batch", "string").add("attempt", "string"))
    if years is not None:
        rows = rows.where(F.col("order_year").isin(list(years)))
    valid = commits(spark, path).withColumnsRenamed({"batch": "valid_batch", "attempt": "valid_attempt"})
    rows = rows.join(valid, (F.col("batch") == F.col("valid_batch")) & (F.col("attempt") == F.col("valid_attempt")))
    rows = rows.withColumn("batch", F.substr("batch", F.lit(len(_ID) + 1)))
    # the folder's year stays as read; its type follows from the years that are there
    year = F.col("order_year").cast("int")
    return with_date_parts(rows.drop("attempt", "valid_batch", "valid_attempt")).withColumn("order_year", year)
