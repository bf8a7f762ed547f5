"""Category, brand, product-lifecycle and price analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.dates import floor_months, month_start
from salesflow.functions.numeric import safe_corr, safe_div, to_number0, total
from salesflow.operators.aggregate import (AMOUNT, group_sum, not_null, pct_change, rollup_totals, share_of, top_n,
                                           top_n_per)
from salesflow.operators.filters import semi_top
from salesflow.operators.stats import corr_matrix, histogram, ols_by
from salesflow.schema import require_columns
from salesflow.session import materialize


# ---- categories ----

def category_revenue(sales: DataFrame) -> DataFrame:
    """Revenue, share and the value-weighted mean amount per subcategory."""
    agg = not_null(sales, ["subcategory"]).groupBy("subcategory").agg(
        total(AMOUNT).alias("revenue"), total(F.col(AMOUNT) * F.col(AMOUNT)).alias("s2"))
    return (agg.select("subcategory", "revenue", share_of("revenue").alias("share_pct"),
                       safe_div("s2", "revenue").alias("weighted_amount"))
            .orderBy(F.desc("revenue"), "subcategory"))


def category_growth(sales: DataFrame) -> DataFrame:
    return pct_change(group_sum(sales, ["order_year", "subcategory"]), "revenue", "order_year", "growth_pct", ["subcategory"])


def category_avg_growth(sales: DataFrame) -> DataFrame:
    return (category_growth(sales).groupBy("subcategory")
            .agg(F.coalesce(F.avg("growth_pct"), F.lit(0.0)).alias("avg_growth_pct"))
            .orderBy(F.desc("avg_growth_pct"), "subcategory"))


# ---- brands ----

def _brand_years(sales: DataFrame) -> DataFrame:
    """Yearly brand revenue, stored since both the ranking and the result read it."""
    return materialize(not_null(sales, ["order_year", "brand"]).groupBy("order_year", "brand").agg(
        total(AMOUNT).alias("revenue"), F.count(AMOUNT).alias("n")))


def _top_brands(years: DataFrame, n: int) -> DataFrame:
    return top_n(years.groupBy("brand").agg(F.sum("revenue").alias("all_years")), n, "all_years", ["brand"]).select("brand")


def brand_years_top(sales: DataFrame, n: int = 10) -> DataFrame:
    """Yearly revenue of the n brands with the most revenue."""
    years = _brand_years(sales)
    return semi_top(years, _top_brands(years, n), "brand").select("order_year", "brand", "revenue")


def brand_share(sales: DataFrame, n: int = 10) -> DataFrame:
    """Yearly share of the top brands: of the market, and averaged over the brand's rows."""
    years = _brand_years(sales)
    shared = years.withColumn("market_share", share_of("revenue", ["order_year"])).withColumn(
        "mean_row_share", safe_div("market_share", F.col("n")))
    return semi_top(shared, _top_brands(years, n), "brand").select("order_year", "brand", "mean_row_share", "market_share")


def brands_in_category(sales: DataFrame, n: int = 10) -> DataFrame:
    return top_n_per(group_sum(sales, ["subcategory", "brand"]), n, "revenue", ["subcategory"], ["brand"])


def brand_rollup(sales: DataFrame) -> DataFrame:
    return rollup_totals(sales, "subcategory", "brand")


# ---- product lifecycle ----

def product_monthly(sales: DataFrame) -> DataFrame:
    """Monthly revenue and units per product with its first-seen name, subcategory and launch date.

    A table without names or subcategories gives null there, one without quantities 0 units. Name and
    subcategory are part of the first group-by (fixed-width buffers, hash aggregation).
    The windows run over the aggregated months of one product, one row per calendar month.
    """
    require_columns(sales, ["order_date", "product_id", AMOUNT])
    meta = ["product_name", "subcategory"]
    absent = {c: F.lit(None).cast(t) for c, t in (("product_name", "string"), ("subcategory", "string"), ("quantity", "int"))
              if c not in sales.columns}
    rows = not_null(sales.withColumns(absent), ["order_date", "product_id"])
    fine = rows.groupBy("product_id", month_start("order_date").alias("order_month"), *meta).agg(
        F.sum(to_number0(AMOUNT)).alias("rev"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("qty"),
        F.min("order_date").alias("since"))
    monthly = fine.groupBy("product_id", "order_month").agg(
        F.sum("rev").alias("monthly_revenue"), F.sum("qty").alias("monthly_qty"), F.min("since").alias("since"),
        F.min_by(F.struct(*meta), F.struct("since", *meta)).alias("meta"))
    whole = Window.partitionBy("product_id")
    return (monthly.withColumn("launch_date", F.min("since").over(whole))
            .withColumn("meta", F.min_by("meta", "order_month").over(whole))
            .select("product_id", "order_month", "monthly_revenue", "monthly_qty", "meta.product_name",
                    "meta.subcategory", "launch_date"))


def product_lifecycle(sales: DataFrame) -> DataFrame:
    """Launch, peak month (earliest on ties), time to peak, total and first-90-day revenue per product."""
    m = product_monthly(sales)
    since = floor_months(F.col("order_month"), F.col("launch_date"))
    early = F.when(since.between(0, 3), F.col("monthly_revenue"))
    out = m.groupBy("product_id").agg(
        F.first("product_name").alias("product_name"), F.first("subcategory").alias("subcategory"),
        F.first("launch_date").alias("launch_date"),
        F.max_by("order_month", F.struct("monthly_revenue", -F.unix_date("order_month"))).alias("peak_month"),
        F.max("monthly_revenue").alias("peak_revenue"), F.sum("monthly_revenue").alias("total_revenue"),
        F.coalesce(F.sum(early), F.lit(0.0)).alias("rev_first_90days"))
    return out.withColumn("time_to_peak_months", floor_months(F.col("peak_month"), F.col("launch_date")))


def launches_per_year(sales: DataFrame) -> DataFrame:
    first = not_null(sales, ["order_date", "product_id"]).groupBy("product_id").agg(
        F.year(F.min("order_date")).alias("launch_year"))
    return first.groupBy("launch_year").agg(F.count(F.lit(1)).alias("launch_count")).orderBy("launch_year")


def time_to_peak_histogram(sales: DataFrame, bins: int = 24) -> DataFrame:
    return histogram(materialize(product_lifecycle(sales)), "time_to_peak_months", bins, alias="products")


def product_curve(sales: DataFrame, product_name: str | None = None, product_id=None) -> DataFrame:
    """Monthly series of one product: by id, or the smallest id that carries the name (first name by default)."""
    m = materialize(product_monthly(sales))   # read twice: to choose the product, and for its months
    if product_id is None:
        named = m.where(F.col("product_name") == product_name) if product_name else m.where(F.col("product_name").isNotNull())
        product_id = named.agg(F.min(F.struct("product_name", "product_id"))["product_id"]).scalar()
    return m.where(F.col("product_id") == product_id).select(
        "product_id", "product_name", "order_month", "monthly_revenue", "monthly_qty").orderBy("order_month")


def top_launches(sales: DataFrame, n: int = 15) -> DataFrame:
    return top_n(product_lifecycle(sales), n, "rev_first_90days", ["product_id"]).select(
        "product_id", "product_name", "rev_first_90days")


# ---- price and demand ----

def _sold(sales: DataFrame) -> DataFrame:
    return sales.where("quantity > 0")


def units_on_price(sales: DataFrame) -> DataFrame:
    """Line of quantity on price per subcategory and brand."""
    return ols_by(_sold(sales), "discounted_price_inr", "quantity", ["subcategory", "brand"])


def price_correlations(sales: DataFrame) -> DataFrame:
    cols = ["original_price_inr", "discount_percent", "discounted_price_inr", "quantity", AMOUNT]
    return corr_matrix(_sold(sales), cols, ["subcategory"])


def price_elasticity(sales: DataFrame) -> DataFrame:
    return (not_null(_sold(sales), ["subcategory"]).groupBy("subcategory")
            .agg(safe_corr("discounted_price_inr", "quantity").alias("price_demand_corr"))
            .orderBy("price_demand_corr", "subcategory"))
