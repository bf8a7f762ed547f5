"""Reading and writing sales tables."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.schema import CLEAN_SCHEMA


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Dirty CSV, every column as text: the cleaning operators own the casts."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned CSV with the fixed 34-column schema; unreadable values become null (``quarantine.load_csv`` keeps them with reasons)."""
    return spark.read.schema(CLEAN_SCHEMA).csv(path, header=True, mode="PERMISSIVE")


def with_order_year(df: DataFrame) -> DataFrame:
    return df.withColumn("order_year", F.year("order_date"))


def with_date_parts(df: DataFrame) -> DataFrame:
    """Re-derive date (unreadable is null), year, month number and month name; a table without dates stays as it is."""
    if "order_date" not in df.columns:
        return df
    if dict(df.dtypes)["order_date"] != "date":
        df = df.withColumn("order_date", F.col("order_date").cast("string").try_cast("date"))
    return (with_order_year(df)
            .withColumn("order_month", F.month("order_date"))
            .withColumn("order_month_name", F.date_format("order_date", "MMMM")))


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one folder per ``order_year``; 'overwrite' replaces the years that ``df`` holds and leaves the others.

    The rebalance hint lets AQE merge small and split large years, so one heavy year is written by
    many tasks and a light one does not leave a file per task.
    """
    df.hint("rebalance", F.col("order_year")).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("order_year").parquet(path)


def append_sales(df: DataFrame, path: str) -> None:
    """Append rows as they are; where a job may be retried, ``batches.append_batch`` replaces a batch instead of doubling it."""
    write_by_year(df, path, mode="append")


def between_years(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows of the years from ``lo`` to ``hi``; a bound that is not given leaves its side open.

    A row without a year lies outside any bound.
    """
    if lo is not None:
        df = df.where(F.col("order_year") >= lo)
    return df.where(F.col("order_year") <= hi) if hi is not None else df


def load_sales(spark: SparkSession, path: str, years: list[int] | None = None,
               cache: bool = False) -> DataFrame:
    """The year-partitioned table, read for ``years`` only (partition pruning).

    Missing years give no rows; a path without data gives an empty table.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df = spark.createDataFrame([], CLEAN_SCHEMA)
    if years is not None:
        df = df.where(F.col("order_year").isin(list(years)))
    # the partition column stays as read, so that year filters added later still prune folders
    year = F.col("order_year")
    df = with_date_parts(df).withColumn("order_year", year) if "order_year" in df.columns else with_date_parts(df)
    return df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df


def union_years(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_rows(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; leading and trailing blanks of a text are kept (Spark drops them by default)."""
    df.write.mode(mode).options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
