"""Discount response, over rows with a known discount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions.numeric import safe_div, total
from salesflow.operators.aggregate import AMOUNT, dense, not_null
from salesflow.operators.stats import corr_matrix, ols_by
from salesflow.plans.revenue import month_name


def _known(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("discount_percent").isNotNull())


def units_on_discount(sales: DataFrame) -> DataFrame:
    """Line of quantity on discount per subcategory."""
    return ols_by(_known(sales), "discount_percent", "quantity", ["subcategory"])


def by_subcategory(sales: DataFrame) -> DataFrame:
    return (not_null(_known(sales), ["subcategory"]).groupBy("subcategory")
            .agg(F.avg("discount_percent").alias("avg_discount"),
                 F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_units"), total(AMOUNT).alias("revenue"))
            .orderBy(F.desc("avg_discount"), "subcategory"))


def best_worst(sales: DataFrame) -> DataFrame:
    """Subcategories with the most and the fewest units (the alphabetically first on ties)."""
    units = not_null(_known(sales), ["subcategory"]).groupBy("subcategory").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_units"))
    row = F.struct("subcategory", "total_units")
    ends = units.agg(F.min_by(row, F.struct(-F.col("total_units"), F.col("subcategory"))).alias("hi"),
                     F.min_by(row, F.struct("total_units", "subcategory")).alias("lo"))
    kinds = F.array(F.struct(F.lit("best").alias("kind"), F.col("hi").alias("row")),
                    F.struct(F.lit("worst").alias("kind"), F.col("lo").alias("row")))
    return ends.select(F.inline(kinds)).where(F.col("row").isNotNull()).select("kind", "row.*")


def monthly(sales: DataFrame) -> DataFrame:
    """Average discount and revenue for every month of every year present."""
    agg = not_null(_known(sales), ["order_year"]).groupBy("order_year", "order_month").agg(
        F.avg("discount_percent").alias("avg_discount"), total(AMOUNT).alias("revenue"))
    rows = dense(agg, ["order_year"], "order_month", list(range(1, 13)),
                 {"avg_discount": None, "revenue": F.lit(0.0)})
    return rows.select("order_year", "order_month", month_name("order_month").alias("order_month_name"),
                       "avg_discount", "revenue").orderBy("order_year", "order_month")


def correlations(sales: DataFrame) -> DataFrame:
    return corr_matrix(_known(sales), ["discount_percent", "quantity", AMOUNT])


def effectiveness(sales: DataFrame) -> DataFrame:
    """Mean of quantity times discount per amount; a zero amount is left out."""
    score = safe_div(F.col("quantity") * F.col("discount_percent"), AMOUNT)
    return (not_null(_known(sales), ["subcategory"]).groupBy("subcategory")
            .agg(F.avg(score).alias("discount_effectiveness"))
            .orderBy(F.desc("discount_effectiveness"), "subcategory"))
