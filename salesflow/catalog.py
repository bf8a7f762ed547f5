"""The named queries: which view and columns each reads, and the function that builds it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from salesflow import fixed_values as fv
from salesflow.functions.numeric import parse_price
from salesflow.functions.text import capitalize, parse_flag
from salesflow.operators import cleaning, filters, profiling, sketches, stats
from salesflow.plans import customer, discount, market, payment, product, revenue
from salesflow.schema import CLEAN_SCHEMA
from salesflow.session import Scratch, scratch
from salesflow.sources import tables
from salesflow.sources.batches import append_batch, load_batches, write_attempt
from salesflow.sources.quarantine import load_csv, quarantined
from salesflow.sources.star import view

MONEY_DIGITS = 2   # large sums of money
OTHER_DIGITS = 6   # means, rates, coefficients
PRICE_DIGITS = 8   # row prices of the raw view, which end within seven decimals
AMT = "final_amount_inr"
BRAND = "Brand#12"
RAW_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


@dataclass(frozen=True)
class Query:
    build: Callable[[DataFrame], DataFrame]
    columns: list[str] | None
    source: str = "sales"
    money: tuple[str, ...] = ()
    digits: int = OTHER_DIGITS
    heavy_share: float | None = None
    stored_lines: bool = False

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.stored_lines:
            lines = Scratch(spark)
            out = self.build(view(spark, sf_dir, self.source, self.columns, self.heavy_share, lines), lines)
        else:
            out = self.build(view(spark, sf_dir, self.source, self.columns, self.heavy_share))
        return out.select(*[self._shown(f) for f in out.schema.fields])

    def _shown(self, f: StructField) -> Column:
        """The engines are compared on rounded numbers, and on flags as text (one form of null)."""
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            return F.round(col, MONEY_DIGITS if f.name in self.money else self.digits).alias(f.name)
        return col.cast("string").alias(f.name) if isinstance(f.dataType, BooleanType) else col


def _raw_prices(raw: DataFrame) -> DataFrame:
    """Number prices of the raw view, derived from its price text."""
    out = raw.withColumn("original_price_inr", parse_price("original_price_inr"))
    out = out.withColumn("discounted_price_inr", F.col("original_price_inr") * (1 - F.col("l_discount")))
    amount = F.col("discounted_price_inr") * F.col("l_quantity")
    return out.withColumns({"subtotal_inr": amount, "final_amount_inr": amount})


def _pipeline(raw: DataFrame, behind: Scratch | None = None) -> DataFrame:
    numbers = _raw_prices(raw.withColumn("price_text", F.col("original_price_inr")))
    numbers = numbers.withColumn("original_price_inr", F.col("price_text")).drop("price_text")
    return cleaning.clean_sales(numbers, RAW_ORDER, behind=behind).drop("l_shipdate", "l_quantity", "l_discount")


def _one(col: str, clean: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Clean one column, keeping the raw text beside it."""
    return lambda df: clean(df.withColumn("raw_value", F.col(col)))


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: parse_flag(c) for c in cleaning.FLAGS})


_RAW_PRICE = ["transaction_id", "brand", "subcategory", "original_price_inr", "l_quantity", "l_discount"]
_PROFILED = ["order_date", "category", "brand", "original_price_inr", "customer_city", "customer_age_group",
             "delivery_days", "customer_rating", "is_prime_member", "festival_name", "l_quantity", "l_discount"]
_NUMBERS = ["original_price_inr", "discount_percent", "discounted_price_inr", "quantity", "subtotal_inr",
            "delivery_charges", AMT, "customer_rating", "product_rating", "product_weight_kg", "delivery_days",
            "is_prime_member", "is_festival_sale"]


def _stored_by_year(df: DataFrame) -> str:
    """The rows, stored one folder per year: even years written first, odd years appended."""
    path = scratch(df.sparkSession).new("sales")
    odd = F.coalesce(F.pmod(F.col("order_year"), F.lit(2)) == 1, F.lit(False))   # rows without a year go with the even ones
    tables.write_by_year(df.where(~odd), path)
    tables.append_sales(df.where(odd), path)
    return path


def _per_month(df: DataFrame) -> DataFrame:
    return df.groupBy("order_year", "order_month", "order_month_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(AMT).alias("revenue"))


def _load_years(years: list[int] | None) -> Callable[[DataFrame], DataFrame]:
    """Write by year, append, load (all years, or those listed; a year without data gives no rows)."""
    def build(df: DataFrame) -> DataFrame:
        path = _stored_by_year(df)
        return _per_month(tables.load_sales(df.sparkSession, path, years))
    return build


def _union(df: DataFrame) -> DataFrame:
    """Union by name of a slice per year, of which those of even years lack the rating column."""
    path = _stored_by_year(df)
    stored = tables.load_sales(df.sparkSession, path)
    years = sorted(r.order_year for r in stored.select("order_year").distinct().collect() if r.order_year is not None)
    frames = [stored.where(F.col("order_year") == y) for y in years]
    frames = [f.drop("customer_rating") if y % 2 == 0 else f for y, f in zip(years, frames)]
    both = tables.union_years(frames or [stored])
    return both.groupBy("order_year").agg(F.count(F.lit(1)).alias("n_rows"), F.count("customer_rating").alias("n_rated"))


def _csv_raw(df: DataFrame) -> DataFrame:
    """Raw text columns through a CSV export and the untyped reader."""
    path = scratch(df.sparkSession).new("csv")
    tables.write_csv(df, path)
    return tables.read_raw_csv(df.sparkSession, path).select(*df.columns) if df.take(1) else df


def _csv_clean(df: DataFrame) -> DataFrame:
    """All columns through a CSV export and the typed reader; columns the source lacks are written empty."""
    path = scratch(df.sparkSession).new("csv")
    have = set(df.columns)
    tables.write_csv(df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLEAN_SCHEMA]), path)
    return tables.read_clean_csv(df.sparkSession, path).groupBy("order_year", "order_month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(AMT).alias("revenue"))


def _heavy_star(df: DataFrame) -> DataFrame:
    return df.groupBy("brand", "customer_tier").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(AMT).alias("revenue"))


_LINE = ["transaction_id", "order_date", "product_name", "quantity", AMT]


def _csv_quarantine(df: DataFrame) -> DataFrame:
    """Lines of which some are broken (by the last digit of the quantity), read back: good rows, and bad lines by reason.

    0 has no date, 1 a field less, 2 a field more, 3 a word for its quantity and no amount, 4 a quoted line break, which is good.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession).new("lines")
    kind, amount = F.col("quantity") % 10, F.col(AMT).cast("string")
    name = F.when(kind == 4, F.concat(F.lit('"'), F.col("product_name"), F.lit('\nsecond ""line"", end"'))).otherwise(F.col("product_name"))
    fields = [F.col("transaction_id"), F.when(kind == 0, F.lit("some day")).otherwise(F.col("order_date").cast("string")), name,
              F.when(kind == 3, F.lit("many")).otherwise(F.col("quantity").cast("string")), F.when(kind == 3, F.lit("?")).otherwise(amount)]
    line = F.when(kind == 1, F.concat_ws(",", *fields[:4])).when(kind == 2, F.concat_ws(",", *fields, F.lit("x"))).otherwise(F.concat_ws(",", *fields))
    df.select(line.alias("value")).write.text(path)
    bad = scratch(spark).new("quarantine")
    good = load_csv(spark, path, StructType([CLEAN_SCHEMA[c] for c in _LINE]), bad, header=False, multiline=True)
    out = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n_lines"), F.sum(AMT).alias("revenue"),
                   F.count_if(F.col("product_name").endswith('second "line", end')).alias("n_line_breaks"))
    return out.unionByName(quarantined(spark, bad), allowMissingColumns=True).fillna(0, ["n_line_breaks"])


def _append_batch(df: DataFrame) -> DataFrame:
    """Two batches: one whose first write is never committed, one that is appended twice."""
    spark, path = df.sparkSession, scratch(df.sparkSession).new("batches")
    even = F.coalesce(F.col("order_year") % 2 == 0, F.lit(True))
    write_attempt(df.where(even & (F.col("order_year") < 1995)), path, "even years")
    for batch, rows in (("odd years", df.where(~even)), ("even years", df.where(even)), ("odd years", df.where(~even))):
        append_batch(rows, path, batch)
    return load_batches(spark, path).groupBy("batch", "order_year", "order_month").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(AMT).alias("revenue"))


_RANGES = [(1992, 1994), (1995, 1998), (1992, 1998)]
_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _approx_quantiles(df: DataFrame) -> DataFrame:
    """Sketches per year and subcategory, stored once and merged for three ranges of years."""
    path, measures = scratch(df.sparkSession).new("sketches"), [AMT, "discounted_price_inr"]
    sketches.store_sketches(df, path, ["subcategory"], measures=measures)
    return sketches.quantiles_hold(df, path, _RANGES, measures, _PROBS)


def _approx_distinct(df: DataFrame) -> DataFrame:
    path, counted = scratch(df.sparkSession).new("sketches"), ["customer_id", "product_id", "transaction_id"]
    sketches.store_sketches(df, path, ["customer_tier"], counted=counted)
    return sketches.distinct_holds(df, path, _RANGES, counted, "customer_tier")


QUERIES: dict[str, Query] = {
    # revenue and business health
    "q_rev_yearly": Query(revenue.yearly, ["order_year", AMT], money=("revenue_inr",)),
    "q_rev_cagr": Query(revenue.cagr, ["order_year", AMT], money=("start_revenue", "end_revenue")),
    "q_rev_trend": Query(revenue.yearly_trend, ["order_year", AMT],
                         money=("revenue_inr", "trend_inr")),
    "q_rev_best_worst": Query(revenue.best_worst_years, ["order_year", AMT], money=("revenue_inr",)),
    "q_rev_month_grid": Query(revenue.month_grid, ["order_year", "order_month", AMT], money=("revenue",)),
    "q_rev_peak_months": Query(revenue.peak_months, ["order_month", AMT], money=("revenue",)),
    "q_rev_top_month": Query(revenue.top_month, ["order_month", AMT], money=("revenue",)),
    "q_health_kpis": Query(revenue.health_kpis, ["customer_id", "transaction_id", AMT], money=("total_revenue",)),
    "q_health_yearly": Query(revenue.health_yearly, ["order_year", AMT], money=("revenue",)),
    "q_health_new_customers": Query(revenue.new_customers, ["customer_id", "order_date"]),
    "q_health_repeat_rate": Query(revenue.repeat_rate, ["customer_id", "transaction_id"]),
    "q_health_delivery": Query(revenue.monthly_delivery, ["order_date", "delivery_days"]),
    "q_health_returns": Query(revenue.monthly_returns, ["order_date", "return_status"]),
    # discount
    "q_disc_ols": Query(discount.units_on_discount, ["subcategory", "discount_percent", "quantity"]),
    "q_disc_subcategory": Query(discount.by_subcategory, ["subcategory", "discount_percent", "quantity", AMT],
                                money=("revenue",)),
    "q_disc_best_worst": Query(discount.best_worst, ["subcategory", "discount_percent", "quantity"]),
    "q_disc_monthly": Query(discount.monthly, ["order_year", "order_month", "discount_percent", AMT], money=("revenue",)),
    "q_disc_corr": Query(discount.correlations, ["discount_percent", "quantity", AMT]),
    "q_disc_effectiveness": Query(discount.effectiveness, ["subcategory", "discount_percent", "quantity", AMT]),
    # customers
    "q_rfm_scores": Query(customer.rfm_scores, ["customer_id", "transaction_id", "order_date", AMT]),
    "q_rfm_segments": Query(customer.rfm_segments, ["customer_id", "transaction_id", "order_date", AMT]),
    "q_cohort_retention": Query(customer.cohort_retention, ["customer_id", "order_date"]),
    "q_cohort_matrix": Query(customer.cohort_cells, ["customer_id", "order_date"]),
    "q_clv_customer": Query(customer.clv_by_customer, ["customer_id", AMT]),
    "q_clv_histogram": Query(customer.clv_histogram, ["customer_id", AMT], money=("bin_lo", "bin_hi")),
    "q_clv_by_tier": Query(customer.clv_by_tier, ["customer_id", "customer_tier", "order_date", AMT], money=("avg_clv",)),
    "q_clv_by_acq_year": Query(customer.clv_by_acquisition_year, ["customer_id", "order_date", AMT], money=("total_clv",)),
    "q_age_spend": Query(customer.age_spend, ["customer_age_group", AMT], money=("total_spend",)),
    "q_age_subcategory": Query(customer.age_subcategory, ["customer_age_group", "subcategory", AMT], money=("revenue",)),
    "q_age_rollup": Query(customer.age_rollup, ["customer_age_group", "subcategory", AMT], money=("revenue",)),
    "q_age_frequency": Query(customer.age_frequency, ["customer_age_group", "order_year"]),
    "q_age_pivot": Query(customer.age_pivot, ["customer_age_group", "subcategory", AMT], money=(
        "age_18_25", "age_26_35", "age_36_45", "age_46_55", "age_55_plus")),
    "q_purchase_freq": Query(customer.purchase_frequency, ["customer_id", "transaction_id"]),
    "q_loyalty_tiers": Query(customer.loyalty_tiers, ["customer_id", "transaction_id"]),
    "q_loyalty_evolution": Query(customer.loyalty_evolution, ["customer_id", "order_year"]),
    "q_return_by_subcategory": Query(customer.returns_by_subcategory, ["subcategory", "return_status"]),
    "q_return_by_price": Query(customer.returns_by_price, ["discounted_price_inr", "return_status"]),
    "q_return_corr": Query(customer.returns_correlation, ["return_status", "customer_rating", "discount_percent",
                                                          "discounted_price_inr", AMT]),
    "q_return_by_rating": Query(customer.returns_by_rating, ["customer_rating", "return_status"]),
    # products
    "q_cat_revenue": Query(product.category_revenue, ["subcategory", AMT], money=("revenue", "weighted_amount")),
    "q_cat_yearly_growth": Query(product.category_growth, ["order_year", "subcategory", AMT], money=("revenue",)),
    "q_cat_avg_growth": Query(product.category_avg_growth, ["order_year", "subcategory", AMT]),
    "q_brand_year_top10": Query(product.brand_years_top, ["order_year", "brand", AMT], money=("revenue",)),
    "q_brand_share": Query(product.brand_share, ["order_year", "brand", AMT]),
    "q_brand_top_in_category": Query(product.brands_in_category, ["subcategory", "brand", AMT], money=("revenue",)),
    "q_brand_rollup": Query(product.brand_rollup, ["subcategory", "brand", AMT], money=("revenue", "weighted_amount")),
    "q_prod_monthly": Query(product.product_monthly, ["product_id", "product_name", "subcategory", "order_date",
                                                      "quantity", AMT]),
    "q_prod_lifecycle": Query(product.product_lifecycle, ["product_id", "product_name", "subcategory", "order_date",
                                                          "quantity", AMT]),
    "q_prod_launches_per_year": Query(product.launches_per_year, ["product_id", "order_date"]),
    "q_prod_ttp_hist": Query(product.time_to_peak_histogram, ["product_id", "product_name", "subcategory", "order_date",
                                                              "quantity", AMT]),
    "q_prod_curve": Query(product.product_curve, ["product_id", "product_name", "subcategory", "order_date",
                                                  "quantity", AMT]),
    "q_prod_top_launches": Query(product.top_launches, ["product_id", "product_name", "subcategory", "order_date",
                                                        "quantity", AMT]),
    "q_price_ols": Query(product.units_on_price, ["subcategory", "brand", "discounted_price_inr", "quantity"]),
    "q_price_corr": Query(product.price_correlations, ["subcategory", "original_price_inr", "discount_percent",
                                                       "discounted_price_inr", "quantity", AMT]),
    "q_price_elasticity": Query(product.price_elasticity, ["subcategory", "discounted_price_inr", "quantity"]),
    # payment, delivery, membership
    "q_pay_share": Query(payment.payment_share, ["order_year", "payment_method", AMT], money=("revenue",)),
    "q_pay_top_latest": Query(payment.top_payment_latest, ["order_year", "payment_method", AMT]),
    "q_deliv_hist": Query(payment.delivery_histogram, ["customer_tier", "delivery_days"]),
    "q_deliv_box": Query(payment.delivery_box, ["customer_tier", "delivery_days"]),
    "q_deliv_on_time": Query(payment.delivery_on_time, ["customer_city", "customer_tier", "delivery_days"]),
    "q_deliv_rating_corr": Query(payment.delivery_rating_corr, ["delivery_days", "customer_rating"]),
    "q_deliv_rating_ols": Query(payment.delivery_rating_line, ["customer_tier", "delivery_days", "customer_rating"]),
    "q_deliv_tier": Query(payment.delivery_by_tier, ["customer_tier", "delivery_days", "customer_rating"]),
    "q_prime_summary": Query(payment.member_summary, ["is_prime_member", "transaction_id", "customer_id", "order_date",
                                                      AMT], money=("revenue",)),
    "q_prime_freq_box": Query(payment.member_order_box, ["is_prime_member", "transaction_id", "customer_id"]),
    "q_prime_subcategory": Query(payment.member_subcategory, ["is_prime_member", "subcategory", AMT], money=("revenue",)),
    "q_prime_share": Query(payment.member_share, ["is_prime_member", AMT], money=("revenue",)),
    # market
    "q_geo_state": Query(market.state_revenue, ["customer_state", AMT], money=("revenue",)),
    "q_geo_tier": Query(market.tier_revenue, ["customer_tier", AMT], money=("revenue",)),
    "q_geo_top_cities": Query(market.top_cities, ["customer_city", AMT], money=("revenue",)),
    "q_geo_tier_yoy": Query(market.tier_growth, ["order_year", "customer_tier", AMT], money=("revenue",)),
    "q_fest_dates": Query(market.festival_dates, ["order_date", "order_year", "festival_name", AMT]),
    "q_fest_impact": Query(market.festival_impact, ["order_date", "order_year", "festival_name", AMT],
                           money=("before_sales", "during_sales", "after_sales")),
    "q_fest_avg_lift": Query(market.festival_avg_lift, ["order_date", "order_year", "festival_name", AMT]),
    "q_fest_series": Query(market.festival_series, ["order_date", "order_year", "festival_name", AMT],
                           money=("revenue",)),
    "q_fest_subcategory_lift": Query(market.festival_subcategory_lift, ["order_date", "order_year", "festival_name",
                                                                        "subcategory", AMT],
                                     money=("before_sales", "during_sales")),
    "q_comp_brands": Query(market.competing_brands, ["brand", "subcategory", "discounted_price_inr", "quantity", AMT],
                           money=("revenue",)),
    "q_comp_price_box": Query(market.price_box, ["brand", "subcategory", "discounted_price_inr", "quantity", AMT]),
    "q_comp_price_tiers": Query(market.price_tiers, ["brand", "subcategory", "discounted_price_inr", "quantity", AMT]),
    # cleaning
    "q_clean_city": Query(_one("customer_city", cleaning.clean_city), ["transaction_id", "customer_city"], "raw_sales"),
    "q_clean_category": Query(_one("category", cleaning.clean_category), ["transaction_id", "category"], "raw_sales"),
    "q_clean_product_name": Query(_one("product_name", lambda d: d.withColumn("product_name", capitalize("product_name"))), ["transaction_id", "product_name"], "raw_sales"),
    "q_clean_dates": Query(_one("order_date", cleaning.clean_dates),
                           ["transaction_id", "order_date"], "raw_sales"),
    "q_clean_dates_iso": Query(_one("order_date", lambda d: cleaning.clean_dates(d, iso_swap=False)),
                               ["transaction_id", "order_date"], "raw_sales"),
    "q_clean_price": Query(_one("original_price_inr", lambda d: d.withColumn(
        "original_price_inr", parse_price("original_price_inr"))), ["transaction_id", "original_price_inr"], "raw_sales"),
    "q_clean_flags": Query(_flags, ["transaction_id", "is_prime_member", "is_festival_sale", "is_prime_eligible"],
                           "raw_sales"),
    "q_clean_delivery": Query(cleaning.clean_delivery, ["transaction_id", "delivery_days"], "raw_sales"),
    "q_clean_rating": Query(cleaning.clean_rating, ["transaction_id", "customer_rating"], "raw_sales"),
    "q_fill_mode": Query(lambda d: cleaning.fill_mode_by_group(d, "customer_age_group", "category"),
                         ["transaction_id", "category", "customer_age_group"], "raw_sales"),
    "q_fill_festival": Query(cleaning.fill_festival, ["transaction_id", "festival_name"], "raw_sales"),
    "q_dedup": Query(lambda d: cleaning.dedup_transactions(d, RAW_ORDER),
                     ["transaction_id", "l_shipdate", "l_partkey", "l_suppkey", "product_name", "customer_city",
                      "l_quantity"], "raw_sales"),
    "q_scale_fix": Query(lambda d: cleaning.fix_scale_errors(_raw_prices(d)).drop("l_quantity", "l_discount"),
                         _RAW_PRICE, "raw_sales", digits=PRICE_DIGITS),
    "q_scale_fix_count": Query(lambda d: cleaning.count_scale_errors(_raw_prices(d)), _RAW_PRICE, "raw_sales"),
    "q_iqr_bounds": Query(lambda d: cleaning.iqr_bounds(_raw_prices(d), fv.CAPPED_COLUMNS), _RAW_PRICE, "raw_sales",
                          digits=PRICE_DIGITS),
    "q_cap_iqr": Query(lambda d: cleaning.cap_iqr(_raw_prices(d), fv.CAPPED_COLUMNS).select(
        "transaction_id", *fv.CAPPED_COLUMNS), _RAW_PRICE, "raw_sales", digits=PRICE_DIGITS),
    "q_clean_pipeline": Query(_pipeline, None, "raw_sales", digits=PRICE_DIGITS, stored_lines=True),
    # profiling
    "q_profile_shape": Query(profiling.profile_shape, _PROFILED, "raw_sales"),
    "q_profile_nulls": Query(profiling.profile_nulls, _PROFILED, "raw_sales"),
    "q_profile_nunique": Query(profiling.profile_nunique, _PROFILED, "raw_sales"),
    "q_profile_nunique_approx": Query(profiling.nunique_holds, _PROFILED, "raw_sales"),
    "q_approx_quantiles": Query(_approx_quantiles, ["order_year", "subcategory", "discounted_price_inr", AMT]),
    "q_approx_distinct": Query(_approx_distinct, ["order_year", "customer_tier", "customer_id", "product_id", "transaction_id"]),
    "q_profile_describe": Query(profiling.profile_describe, _PROFILED, "raw_sales", digits=PRICE_DIGITS),
    "q_missing_map": Query(lambda d: profiling.missing_map(d, "l_partkey", 20), ["l_partkey", *_PROFILED], "raw_sales"),
    "q_value_counts": Query(lambda d: profiling.value_counts(
        d, "customer_city", 10, cleaning.clean_city), ["customer_city"], "raw_sales"),
    "q_value_shares": Query(lambda d: profiling.value_shares(cleaning.fill_festival(d), "festival_name"),
                            ["festival_name"]),
    "q_corr_matrix": Query(lambda d: stats.corr_matrix(d, _NUMBERS), _NUMBERS),
    "q_max_for_brand": Query(lambda d: profiling.max_for_brand(_raw_prices(d), "noise", AMT), ["brand", "original_price_inr",
                             "l_quantity", "l_discount"], "raw_sales", ("max_value",)),
    "q_product_price_range": Query(lambda d: profiling.product_price_range(d, "BLUE (bolt|gear)"),
                                   ["product_name", "discounted_price_inr"]),
    "q_product_names": Query(lambda d: profiling.product_names(d, "BLUE (bolt|gear)"), ["product_name"]),
    "q_find_products": Query(lambda d: filters.find_products(d, "widget"),
                             ["transaction_id", "product_name", AMT]),
    "q_distinct_values": Query(lambda d: filters.distinct_values(d, "delivery_days"), ["delivery_days"], "raw_sales"),
    "q_z_test": Query(lambda d: stats.z_test(d, BRAND, "discounted_price_inr"), ["brand", "discounted_price_inr"]),
    "q_t_test": Query(lambda d: stats.t_test_1samp(d, BRAND, "discounted_price_inr"), ["brand", "discounted_price_inr"]),
    "q_price_histogram": Query(lambda d: stats.histogram(d, "discounted_price_inr", 40, ["subcategory"]),
                               ["subcategory", "discounted_price_inr"]),
    # loading and filtering
    "q_filters": Query(lambda d: filters.apply_filters(d, [1997, 1998], ["PROMO", "LARGE"], ["Brand#1", "Brand#12"]),
                       ["transaction_id", "order_year", "subcategory", "brand", AMT]),
    "q_filters_latest": Query(lambda d: filters.apply_filters(d, brands=["Brand#7"]),
                              ["transaction_id", "order_year", "brand", AMT]),
    "q_filter_options": Query(lambda d: filters.filter_options(d, "brand"), ["brand"]),
    "q_load_years": Query(_load_years(None), ["order_date", "order_year", AMT], money=("revenue",)),
    "q_load_year_list": Query(_load_years([1890, 1996, 1998]), ["order_date", "order_year", AMT], money=("revenue",)),
    "q_union_years": Query(_union, ["order_date", "order_year", "customer_rating"]),
    "q_csv_raw": Query(_csv_raw, ["transaction_id", "brand", "customer_city"], "raw_sales"),
    "q_csv_clean": Query(_csv_clean, ["transaction_id", "order_year", "order_month", AMT], money=("revenue",)),
    "q_csv_quarantine": Query(_csv_quarantine, _LINE, money=("revenue",)),
    "q_append_batch": Query(_append_batch, ["order_date", "order_year", AMT], money=("revenue",)),
    "q_star_heavy": Query(_heavy_star, ["brand", "customer_tier", AMT], money=("revenue",), heavy_share=0.0005),
    "q_profile_types": Query(profiling.infer_types, _PROFILED, "raw_sales"),
    "q_sample_rows": Query(lambda d: tables.sample_rows(d, 5, ["transaction_id", AMT]), ["transaction_id", "order_date", AMT]),
}
