"""Revenue, seasonality and business-health analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.dates import month_start
from salesflow.functions.numeric import total
from salesflow.operators.aggregate import AMOUNT, arg_extremes, dense, group_sum, not_null, pct_change
from salesflow.operators.stats import trend
from salesflow.sources.tables import between_years


def _by_year(sales: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    return group_sum(not_null(between_years(sales, lo, hi), ["order_year"]), ["order_year"], alias="revenue_inr")


def yearly(sales: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Revenue per year (of all years, or in the range) and its change against the year before."""
    return pct_change(_by_year(sales, lo, hi), "revenue_inr", "order_year", "yoy_pct")


def cagr(sales: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    ends = _by_year(sales, lo, hi).agg(
        F.min("order_year").alias("start_year"), F.max("order_year").alias("end_year"),
        F.min_by("revenue_inr", "order_year").alias("start_revenue"),
        F.max_by("revenue_inr", "order_year").alias("end_revenue"))
    years = F.greatest(F.lit(1), F.col("end_year") - F.col("start_year"))
    growth = F.pow(F.col("end_revenue") / F.nullif("start_revenue", F.lit(0.0)), F.lit(1.0) / years) - 1
    return (ends.where(F.col("start_year").isNotNull())
            .withColumn("cagr_pct", F.when(F.col("start_revenue") > 0, growth * 100)))


def yearly_trend(sales: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    return trend(_by_year(sales, lo, hi), "order_year", "revenue_inr", "trend_inr")


def best_worst_years(sales: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Years with the highest and lowest growth, earliest on ties."""
    return arg_extremes(yearly(sales, lo, hi), "yoy_pct", F.col("order_year"),
                        ["order_year", "revenue_inr", "yoy_pct"])


def month_grid(sales: DataFrame) -> DataFrame:
    """Year by month revenue, in month order."""
    return (group_sum(sales, ["order_year", "order_month"])
            .withColumn("order_month_name", month_name("order_month"))
            .orderBy("order_year", "order_month"))


def month_name(col: str):
    return F.get(F.array(*[F.lit(m) for m in fv.MONTH_NAMES]), F.col(col) - 1)


def peak_months(sales: DataFrame) -> DataFrame:
    """Revenue of all twelve months; a month without sales is null."""
    rows = dense(group_sum(sales, ["order_month"]), [], "order_month", list(range(1, 13)), {"revenue": None})
    return rows.select("order_month", month_name("order_month").alias("order_month_name"), "revenue").orderBy("order_month")


def top_month(sales: DataFrame) -> DataFrame:
    best = group_sum(sales, ["order_month"]).orderBy(F.desc("revenue"), "order_month").limit(1)
    return best.select(month_name("order_month").alias("order_month_name"), "revenue")


def health_kpis(sales: DataFrame, approx: bool = False) -> DataFrame:
    """Revenue, customers and orders. ``approx`` counts with sketches instead of two exact distincts."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return sales.agg(total(AMOUNT).alias("total_revenue"), distinct("customer_id").alias("customers"),
                     distinct("transaction_id").alias("orders"))


def health_yearly(sales: DataFrame) -> DataFrame:
    return group_sum(sales, ["order_year"]).orderBy("order_year")


def new_customers(sales: DataFrame) -> DataFrame:
    """Customers by the month of their first order."""
    first = not_null(sales, ["customer_id"]).groupBy("customer_id").agg(month_start(F.min("order_date")).alias("month"))
    return not_null(first, ["month"]).groupBy("month").agg(F.count(F.lit(1)).alias("new_customers")).orderBy("month")


def repeat_rate(sales: DataFrame) -> DataFrame:
    """Share of customers with more than one distinct order."""
    orders = not_null(sales, ["customer_id"]).groupBy("customer_id").agg(F.count_distinct("transaction_id").alias("n"))
    return orders.agg((F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)) * 100).alias("repeat_rate_pct"))


def monthly_delivery(sales: DataFrame) -> DataFrame:
    months = sales.select(month_start("order_date").alias("month"), "delivery_days")
    return not_null(months, ["month"]).groupBy("month").agg(F.avg("delivery_days").alias("avg_delivery_days")).orderBy("month")


def monthly_returns(sales: DataFrame) -> DataFrame:
    """Share of rows marked exactly 'Returned'; rows without a status count in the base."""
    hit = F.when(F.col("return_status") == "Returned", 1.0).otherwise(0.0)
    months = sales.select(month_start("order_date").alias("month"), hit.alias("hit"))
    return not_null(months, ["month"]).groupBy("month").agg((F.avg("hit") * 100).alias("return_rate_pct")).orderBy("month")
