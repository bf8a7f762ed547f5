"""Payment, delivery and membership analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.numeric import safe_corr, safe_div, total
from salesflow.operators.aggregate import AMOUNT, group_sum, not_null, share_of
from salesflow.operators.stats import box_of_counts, box_summary, histogram, ols_by


def payment_share(sales: DataFrame) -> DataFrame:
    """Revenue and yearly share per payment method."""
    return group_sum(sales, ["order_year", "payment_method"]).withColumn("share_pct", share_of("revenue", ["order_year"]))


def top_payment_latest(sales: DataFrame) -> DataFrame:
    """The leading method of the last year."""
    return payment_share(sales).orderBy(F.desc("order_year"), F.desc("share_pct"), "payment_method").limit(1).select(
        "order_year", "payment_method", "share_pct")


def _delivered(sales: DataFrame) -> DataFrame:
    return sales.where(F.col("delivery_days") >= 0)


def _on_time_pct():
    return F.avg(F.when(F.col("delivery_days") <= fv.ON_TIME_DAYS, 1.0).otherwise(0.0)) * 100


def delivery_histogram(sales: DataFrame) -> DataFrame:
    return histogram(_delivered(sales), "delivery_days", 20, ["customer_tier"], "orders")


def delivery_box(sales: DataFrame) -> DataFrame:
    """Five-number summary of the days per tier; days are whole numbers in a short range."""
    return box_summary(_delivered(sales), "delivery_days", ["customer_tier"], few_values=True)


def delivery_on_time(sales: DataFrame) -> DataFrame:
    return (not_null(_delivered(sales), ["customer_city", "customer_tier"]).groupBy("customer_city", "customer_tier")
            .agg(_on_time_pct().alias("on_time_pct")))


def delivery_rating_corr(sales: DataFrame) -> DataFrame:
    """Correlation of days and rating, with the verdict drawn from its sign."""
    return _delivered(sales).agg(safe_corr("delivery_days", "customer_rating").alias("corr")).withColumn(
        "verdict", F.when(F.col("corr") < 0, "negative").otherwise("weak or positive"))


def delivery_rating_line(sales: DataFrame) -> DataFrame:
    return ols_by(_delivered(sales), "delivery_days", "customer_rating", ["customer_tier"])


def delivery_by_tier(sales: DataFrame) -> DataFrame:
    return (not_null(_delivered(sales), ["customer_tier"]).groupBy("customer_tier")
            .agg(F.avg("delivery_days").alias("avg_delivery_days"), _on_time_pct().alias("on_time_pct"),
                 F.avg("customer_rating").alias("avg_rating")))


def _member_type():
    return F.when(F.col("is_prime_member"), "Prime").otherwise("Non-Prime").alias("member_type")


def member_summary(sales: DataFrame) -> DataFrame:
    """Orders, customers, revenue and averages of members and non-members."""
    agg = not_null(sales, ["is_prime_member"]).groupBy("is_prime_member").agg(
        F.count_distinct("transaction_id").alias("orders"), F.count_distinct("customer_id").alias("customers"),
        total(AMOUNT).alias("revenue"), F.count("order_date").alias("dated_rows"),
        F.avg(AMOUNT).alias("avg_order_value"))
    return agg.select(_member_type(), "orders", "customers", "revenue", "dated_rows", "avg_order_value",
                      safe_div(F.col("orders"), "customers").alias("orders_per_customer"))


def member_order_box(sales: DataFrame) -> DataFrame:
    """Five-number summary of the rows per customer, members against the others."""
    per_customer = not_null(sales, ["customer_id", "is_prime_member"]).groupBy("customer_id", "is_prime_member").agg(
        F.count("transaction_id").alias("order_count"))
    counts = per_customer.groupBy("is_prime_member", "order_count").agg(F.count(F.lit(1)).alias("w"))
    return box_of_counts(counts.withColumn("member_type", _member_type()), "order_count", "w", ["member_type"])


def member_subcategory(sales: DataFrame) -> DataFrame:
    return group_sum(sales, ["is_prime_member", "subcategory"]).select(_member_type(), "subcategory", "revenue")


def member_share(sales: DataFrame) -> DataFrame:
    return group_sum(sales, ["is_prime_member"]).select(_member_type(), "revenue", share_of("revenue").alias("share_pct"))
