"""Customer segmentation, lifetime value, age groups, loyalty and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.dates import month_start, months_apart
from salesflow.functions.numeric import cut, safe_div, total
from salesflow.functions.text import is_returned, strip_text, title_case
from salesflow.operators.aggregate import AMOUNT, dense, group_sum, not_null, share_of
from salesflow.operators.ordering import quintile_scores
from salesflow.operators.stats import corr_matrix, histogram
from salesflow.schema import detect_column
from salesflow.session import materialize


# ---- recency, frequency, monetary value ----

def rfm_scores(sales: DataFrame) -> DataFrame:
    """Recency, frequency and spend per customer with 1-5 scores; day 0 is the day after the last order.

    The customer table is stored once: the scores read it several times and its float sums must
    not change between reads.
    """
    rows = not_null(sales, ["order_date", "customer_id"])
    base = materialize(rows.groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"), F.count_distinct("transaction_id").alias("frequency"),
        total(AMOUNT).alias("monetary")))
    last = base.agg(F.max("last_order")).scalar()
    base = base.withColumn("recency_days", F.datediff(F.date_add(last, 1), "last_order"))
    scored = quintile_scores(base, "customer_id", {
        "r_score": ("recency_days", True), "f_score": ("frequency", False), "m_score": ("monetary", False)})
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def rfm_segments(sales: DataFrame) -> DataFrame:
    """Customers per segment; the first matching rule names the segment."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
               .when((r >= 4) & (f >= 3), "Loyal")
               .when((r == 5) & (f <= 2), "New")
               .when((r <= 2) & (f >= 4), "At Risk")
               .when((r <= 2) & (f <= 2) & (m <= 2), "Hibernating")
               .otherwise("Needs Attention"))
    return (rfm_scores(sales).groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("customers"), "segment"))


# ---- cohorts and lifetime value ----

def cohort_retention(sales: DataFrame) -> DataFrame:
    """Customers of each first-order month that order again n months later.

    Distinct (customer, month) pairs are found by a hash aggregate with fixed-width keys, combined on the
    map side; everything after works on those pairs.
    """
    months = not_null(sales.select("customer_id", month_start("order_date").alias("month")), ["customer_id", "month"])
    pairs = months.groupBy("customer_id", "month").agg(F.count(F.lit(1)).alias("orders"))
    first = F.min("month").over(Window.partitionBy("customer_id"))   # at most one row per calendar month
    active = pairs.select(first.alias("cohort_month"), "month")
    counts = active.groupBy("cohort_month", months_apart(F.col("month"), F.col("cohort_month")).alias("months_since")).agg(
        F.count(F.lit(1)).alias("customers"))
    size = F.max(F.when(F.col("months_since") == 0, F.col("customers"))).over(Window.partitionBy("cohort_month"))
    return (counts.withColumn("cohort_size", size)
            .withColumn("retention_rate", F.col("customers") / F.col("cohort_size")))


def cohort_matrix(sales: DataFrame) -> DataFrame:
    """Retention of each cohort as one dense array: ``rates[n]`` is the share that orders n months after the first order.

    All arrays reach to the last month that any cohort has; a month without orders is null. The shape of the
    result does not depend on the data, and calendar months bound the arrays.
    """
    cells = materialize(cohort_retention(sales))
    last = cells.agg(F.max("months_since")).scalar()
    rates = F.map_from_entries(F.collect_list(F.struct("months_since", "retention_rate")))
    by_month = cells.groupBy("cohort_month").agg(rates.alias("found")).withColumn("months", F.sequence(F.lit(0), last))
    return by_month.select("cohort_month", F.transform("months", lambda m: F.try_element_at("found", m)).alias("rates"))


def cohort_cells(sales: DataFrame) -> DataFrame:
    """The matrix cell by cell, absent ones included: cohort_month, months_since, retention_rate."""
    return cohort_matrix(sales).select("cohort_month", F.posexplode("rates").alias("months_since", "retention_rate"))


def cohort_columns(sales: DataFrame, months: list[int]) -> DataFrame:
    """The matrix with one column ``m<n>`` for each number of months asked for."""
    return cohort_matrix(sales).select("cohort_month", *[F.get("rates", F.lit(m)).alias(f"m{m}") for m in months])


def clv_by_customer(sales: DataFrame) -> DataFrame:
    return group_sum(sales, ["customer_id"], alias="clv")


def clv_histogram(sales: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(materialize(clv_by_customer(sales)), "clv", bins, alias="customers")


def clv_by_tier(sales: DataFrame) -> DataFrame:
    """Mean lifetime value by the tier of the customer's first order that has one.

    Tiers are part of the first group-by, which keeps its buffers fixed-width (hash aggregation).
    """
    per = not_null(sales, ["customer_id"]).groupBy("customer_id", "customer_tier").agg(
        total(AMOUNT).alias("clv"), F.min("order_date").alias("since"))
    first = F.min_by("customer_tier", F.when(F.col("customer_tier").isNotNull(), F.struct("since", "customer_tier")))
    per = per.groupBy("customer_id").agg(F.sum("clv").alias("clv"), first.alias("customer_tier"))
    return not_null(per, ["customer_tier"]).groupBy("customer_tier").agg(F.avg("clv").alias("avg_clv"))


def clv_by_acquisition_year(sales: DataFrame) -> DataFrame:
    """Lifetime revenue of the customers won in each year (a total, not a mean)."""
    per = not_null(sales, ["customer_id"]).groupBy("customer_id").agg(
        F.year(F.min("order_date")).alias("acquisition_year"), total(AMOUNT).alias("clv"))
    return group_sum(per, ["acquisition_year"], "clv", "total_clv").orderBy("acquisition_year")


# ---- age groups ----

def _aged(sales: DataFrame) -> DataFrame:
    return sales.withColumn("age_group", title_case(strip_text("customer_age_group")))


def age_spend(sales: DataFrame) -> DataFrame:
    """Orders, mean and total per age group; every group appears, other labels drop."""
    agg = _by_age(sales, []).agg(F.count(AMOUNT).alias("orders"), F.avg(AMOUNT).alias("avg_spend"),
                                 total(AMOUNT).alias("total_spend"))
    return _tidy(dense(_tidied(agg, []), [], "age_group", fv.AGE_GROUPS,
                       {"orders": F.lit(0), "avg_spend": None, "total_spend": F.lit(0.0)}))


def _by_age(sales: DataFrame, keys: list[str]):
    """Group by the raw label first: the text work then runs once per distinct label."""
    return not_null(sales, keys).groupBy(*keys, "customer_age_group")


def _tidied(agg: DataFrame, keys: list[str]) -> DataFrame:
    """Clean the label of an aggregated frame and merge the spellings that meet."""
    tidy = _aged(agg).drop("customer_age_group")
    out = []
    if "orders" in agg.columns:
        out.append(F.sum("orders").alias("orders"))
    if "avg_spend" in agg.columns:
        out.append(safe_div(F.sum("total_spend"), F.sum("orders")).alias("avg_spend"))
    for c in ("total_spend", "revenue", "order_count"):
        if c in agg.columns:
            out.append(F.sum(c).alias(c))
    return tidy.groupBy(*keys, "age_group").agg(*out)


def _tidy(df: DataFrame) -> DataFrame:
    """Rows in the order of their labels (age groups, tiers, bands); ``ord`` is the label's position from 0."""
    return df.orderBy("ord")


def age_subcategory(sales: DataFrame) -> DataFrame:
    agg = _by_age(sales, ["subcategory"]).agg(total(AMOUNT).alias("revenue"))
    return _tidy(dense(_tidied(agg, ["subcategory"]), ["subcategory"], "age_group", fv.AGE_GROUPS,
                       {"revenue": F.lit(0.0)}))


def age_rollup(sales: DataFrame) -> DataFrame:
    """Age group to subcategory totals with their parents."""
    rows = age_subcategory(sales).rollup("age_group", "subcategory").agg(
        F.grouping_id().alias("gid"), F.sum("revenue").alias("revenue"))
    level = F.when(F.col("gid") == 0, "child").when(F.col("gid") == 1, "parent").otherwise("all")
    return rows.select(level.alias("level"), "age_group", "subcategory", F.coalesce("revenue", F.lit(0.0)).alias("revenue"))


def age_frequency(sales: DataFrame) -> DataFrame:
    agg = _by_age(sales, ["order_year"]).agg(F.count(F.lit(1)).alias("order_count"))
    return _tidy(dense(_tidied(agg, ["order_year"]), ["order_year"], "age_group", fv.AGE_GROUPS,
                       {"order_count": F.lit(0)}))


def age_pivot(sales: DataFrame) -> DataFrame:
    """Subcategory by age group, wide, absent cells 0."""
    agg = _tidied(_by_age(sales, ["subcategory"]).agg(total(AMOUNT).alias("revenue")), ["subcategory"])
    wide = agg.groupBy("subcategory").pivot("age_group", fv.AGE_GROUPS).agg(F.sum("revenue"))
    return wide.select("subcategory", *[
        F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias("age_" + g.replace("-", "_").replace("+", "_plus"))
        for g in fv.AGE_GROUPS])


# ---- loyalty ----

def purchase_frequency(sales: DataFrame) -> DataFrame:
    """Customers by their number of distinct orders."""
    per = not_null(sales, ["customer_id"]).groupBy("customer_id").agg(
        F.count_distinct("transaction_id").alias("purchases"))
    return per.groupBy("purchases").agg(F.count(F.lit(1)).alias("customer_count")).orderBy("purchases")


def loyalty_tiers(sales: DataFrame) -> DataFrame:
    counts = purchase_frequency(sales).withColumn(
        "loyalty_tier", cut("purchases", fv.LOYALTY_EDGES, fv.LOYALTY_TIERS))
    agg = counts.groupBy("loyalty_tier").agg(F.sum("customer_count").alias("customer_count"))
    rows = dense(agg, [], "loyalty_tier", fv.LOYALTY_TIERS, {"customer_count": F.lit(0)})
    return _tidy(rows.withColumn("share_pct", share_of("customer_count")))


def loyalty_evolution(sales: DataFrame) -> DataFrame:
    """Customers per year and tier; tiers are the quartiles of all yearly order counts.

    Everything after the (year, customer) count works on (year, count) pairs. Distinct order counts
    are few (their sum is the row count), so the built-in percentile stays small.
    """
    yearly = not_null(sales, ["order_year", "customer_id"]).groupBy("order_year", "customer_id").agg(
        F.count(F.lit(1)).alias("yearly_orders"))
    counts = materialize(yearly.groupBy("order_year", "yearly_orders").agg(F.count(F.lit(1)).alias("w")))
    q = counts.agg(F.percentile(F.col("yearly_orders").cast("double"), F.array(*[F.lit(p) for p in (.25, .5, .75)]),
                                F.col("w"))).scalar()
    x = F.col("yearly_orders")
    tier = (F.when(x <= q[0], fv.LOYALTY_TIERS[0]).when(x <= q[1], fv.LOYALTY_TIERS[1])
            .when(x <= q[2], fv.LOYALTY_TIERS[2]).otherwise(fv.LOYALTY_TIERS[3]))
    rows = counts.groupBy("order_year", tier.alias("loyalty_tier")).agg(F.sum("w").alias("customer_count"))
    place = F.array_position(F.array(*[F.lit(t) for t in fv.LOYALTY_TIERS]), F.col("loyalty_tier")).cast("int") - 1
    return rows.withColumn("ord", place).orderBy("order_year", "ord")


# ---- returns ----

def _returned(sales: DataFrame, keep: list[str]) -> DataFrame:
    col = detect_column(sales, "return")
    return sales.select(*keep, is_returned(col).cast("int").alias("is_returned"))


def _rate():
    return (F.avg("is_returned") * 100).alias("return_rate")


def returns_by_subcategory(sales: DataFrame) -> DataFrame:
    rows = not_null(_returned(sales, ["subcategory"]), ["subcategory"])
    return rows.groupBy("subcategory").agg(_rate()).orderBy(F.desc("return_rate"), "subcategory")


def returns_by_price(sales: DataFrame) -> DataFrame:
    """Return rate of six right-closed price bands; every band appears."""
    rows = _returned(sales, ["discounted_price_inr"])
    agg = rows.groupBy(cut("discounted_price_inr", fv.PRICE_BAND_EDGES, fv.PRICE_BANDS).alias("price_range")).agg(_rate())
    return _tidy(dense(agg, [], "price_range", fv.PRICE_BANDS, {"return_rate": None}))


def returns_correlation(sales: DataFrame) -> DataFrame:
    cols = ["customer_rating", "discount_percent", "discounted_price_inr", AMOUNT]
    return corr_matrix(_returned(sales, cols), ["is_returned", *cols])


def returns_by_rating(sales: DataFrame) -> DataFrame:
    rows = not_null(_returned(sales, ["customer_rating"]), ["customer_rating"])
    return rows.groupBy("customer_rating").agg(_rate()).orderBy("customer_rating")
