"""Filters, conditional updates and option lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_filters(df: DataFrame, years: list[int] | None = None, subcategories: list[str] | None = None,
                  brands: list[str] | None = None) -> DataFrame:
    """Keep the picked members; an empty list keeps everything.

    ``years=None`` means the latest year, found by one scalar subquery.
    """
    if years is None:
        df = df.where(F.col("order_year") == df.agg(F.max("order_year")).scalar())
    elif years:
        df = df.where(F.col("order_year").isin(list(years)))
    if subcategories:
        df = df.where(F.col("subcategory").isin(list(subcategories)))
    if brands:
        df = df.where(F.col("brand").isin(list(brands)))
    return df


def filter_options(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values, sorted."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values, null included."""
    return df.select(col).distinct()


def find_products(df: DataFrame, pattern: str, col: str = "product_name") -> DataFrame:
    """Rows whose name matches the regular expression, ignoring case; null never matches."""
    return df.where(F.col(col).rlike("(?i)" + pattern))


def divide_where(df: DataFrame, cond: Column, cols: list[str], divisor: float) -> DataFrame:
    """Divide ``cols`` where ``cond`` holds; a null condition leaves the row as it is."""
    return df.withColumns({c: F.when(cond, F.col(c) / divisor).otherwise(F.col(c)) for c in cols})


def semi_top(df: DataFrame, top: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is in ``top``, which must be a top-N result (N rows at most)."""
    return df.join(F.broadcast(top), key, "left_semi")
