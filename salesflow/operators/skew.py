"""Joins whose fact side has heavy keys, without relying on adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.session import materialize


def heavy_keys(fact: DataFrame, key: str, share: float) -> DataFrame:
    """The keys that hold at least ``share`` of the rows: at most 1 / share of them, found by one counted pass and stored."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    counts = materialize(fact.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("heavy_key")).agg(F.count(F.lit(1)).alias("heavy_rows")))
    least = counts.agg(F.sum("heavy_rows") * share).scalar()
    return materialize(counts.where(F.col("heavy_rows") >= least))


def skew_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, share: float = 0.001) -> DataFrame:
    """Inner join of a fact with a dimension (one row per ``dim_key``) in two parts.

    Rows of heavy keys stay where they are and meet a broadcast of their few dimension rows; the others are joined as
    Spark sees fit, and no key among them holds more than ``share`` of the rows. Null keys match nothing. The list of heavy
    keys has at most 1 / share rows; should the dimension repeat keys, so that their rows are more than that, they are
    not broadcast by hint.
    """
    heavy = heavy_keys(fact, fact_key, share).select("heavy_key")
    rows = materialize(dim.join(F.broadcast(heavy), F.col(dim_key) == F.col("heavy_key"), "left_semi"))
    small = rows.count() <= 1 / share
    hot = fact.join(F.broadcast(heavy), F.col(fact_key) == F.col("heavy_key"), "left_semi")
    hot = hot.join(F.broadcast(rows) if small else rows, F.col(fact_key) == F.col(dim_key))
    rest = fact.join(F.broadcast(heavy), F.col(fact_key) == F.col("heavy_key"), "left_anti")
    return hot.unionByName(rest.join(dim, F.col(fact_key) == F.col(dim_key)))
