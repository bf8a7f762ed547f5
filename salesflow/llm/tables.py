"""Reading the given tables, and exact numbering of sorted rows without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(rows: DataFrame, groups: list[str], order: list[str], sizes: dict[str, str]) -> DataFrame:
    """Exclusive running sums per group in ``order``; ``sizes`` maps a new column to the summed one.

    The rows are range-partitioned and stored with the number of their range, so a hot group spans
    many ranges; sums per (group, range) give every range its start, and a window runs only inside
    one range. Runs a Spark job when called. Null keys sort first and form a group of their own.
    """
    keys = groups + order
    stored = materialize(rows.repartitionByRange(*keys).withColumn("range_no", F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy(*groups, "range_no").agg(*[F.sum(c).alias(n) for n, c in sizes.items()])
    starts = materialize(starts.select(*[F.col(g).alias(f"start_{g}") for g in groups], F.col("range_no").alias("start_no"), *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"start_{n}") for n in sizes]))
    here = Window.partitionBy(*groups, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = stored.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"inner_{n}") for n, c in sizes.items()])
    same = F.col("range_no") == F.col("start_no")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"start_{g}"))
    out = inner.join(starts, same)
    return out.select(*rows.columns, *[(F.col(f"inner_{n}") + F.col(f"start_{n}")).alias(n) for n in sizes])
