"""Geography, festival impact and competitive pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.numeric import safe_div, to_number0, total
from salesflow.functions.text import festival_key, map_state
from salesflow.operators.aggregate import AMOUNT, group_sum, not_null, pct_change, share_of, top_n, top_n_per
from salesflow.operators.ordering import exact_quantiles
from salesflow.operators.stats import box_summary, qcut
from salesflow.schema import require_columns
from salesflow.session import materialize


# ---- geography ----

def state_revenue(sales: DataFrame) -> DataFrame:
    by_raw = group_sum(sales, ["customer_state"]).withColumn("customer_state", map_state("customer_state"))
    return by_raw.groupBy("customer_state").agg(F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), "customer_state")


def tier_revenue(sales: DataFrame) -> DataFrame:
    return group_sum(sales, ["customer_tier"]).orderBy(F.desc("revenue"), "customer_tier")


def top_cities(sales: DataFrame, n: int = 15) -> DataFrame:
    return top_n(group_sum(sales, ["customer_city"]), n, "revenue", ["customer_city"])


def tier_growth(sales: DataFrame) -> DataFrame:
    return pct_change(group_sum(sales, ["order_year", "customer_tier"]), "revenue", "order_year", "yoy_pct", ["customer_tier"])


# ---- festivals ----

def _daily(sales: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Revenue per day and festival. Keyword tests run on distinct names, not on fact rows.

    Callers that read it more than once store it: it is as small as the calendar, while filters
    pushed into each use would otherwise turn them into separate scans of the sales.
    """
    rows = not_null(sales, ["order_date"]).groupBy("order_date", "order_year", "festival_name", *extra).agg(
        total(AMOUNT).alias("revenue"))
    return rows.withColumn("festival", festival_key("festival_name"))


def _first_days(daily: DataFrame) -> DataFrame:
    return (daily.where(F.col("festival") != fv.NO_FESTIVAL_KEY).groupBy("festival", "order_year")
            .agg(F.min("order_date").alias("festival_date")))


def festival_dates(sales: DataFrame) -> DataFrame:
    """First day of each festival in each year."""
    return _first_days(_daily(sales))


def _window_days(dates: DataFrame, before: int, after: int) -> DataFrame:
    """One row per festival date and day of its window, so that the range join becomes an equi-join."""
    day = F.explode(F.sequence(F.date_sub("festival_date", before), F.date_add("festival_date", after)))
    return dates.withColumn("order_date", day)


def festival_impact(sales: DataFrame, before_days: int = 15, after_days: int = 15) -> DataFrame:
    """All sales before, on and after each festival's first day, and the lift over the mean day before."""
    daily = materialize(_daily(sales))
    days = _window_days(_first_days(daily), before_days, after_days)
    per_day = daily.groupBy("order_date").agg(F.sum("revenue").alias("revenue"))
    d, f = F.col("order_date"), F.col("festival_date")
    out = days.join(per_day, "order_date").groupBy("festival", "order_year").agg(
        total(F.when(d < f, F.col("revenue"))).alias("before_sales"),
        total(F.when(d == f, F.col("revenue"))).alias("during_sales"),
        total(F.when(d > f, F.col("revenue"))).alias("after_sales"))
    base = F.col("before_sales") / before_days
    lift = F.when(F.col("before_sales") > 0, safe_div(F.col("during_sales") - base, base) * 100).otherwise(0.0)
    return out.withColumn("lift_pct", F.bround(lift, 2)).orderBy(F.desc("lift_pct"), "festival", "order_year")


def festival_avg_lift(sales: DataFrame, before_days: int = 15, after_days: int = 15) -> DataFrame:
    return (festival_impact(sales, before_days, after_days).groupBy("festival")
            .agg(F.avg("lift_pct").alias("avg_lift_pct")).orderBy(F.desc("avg_lift_pct"), "festival"))


def festival_series(sales: DataFrame, festival: str | None = None, before_days: int = 15,
                    after_days: int = 15) -> DataFrame:
    """Daily revenue around every date of one festival (or of all); days without sales are absent."""
    daily = materialize(_daily(sales))
    dates = _first_days(daily)
    if festival:
        dates = dates.where(F.col("festival") == festival)
    per_day = daily.groupBy("order_date").agg(F.sum("revenue").alias("revenue"))
    return _window_days(dates, before_days, after_days).join(per_day, "order_date").select(
        "festival", "order_year", "festival_date", "order_date", "revenue")


def festival_subcategory_lift(sales: DataFrame, festival: str | None = None, before_days: int = 15,
                              n: int = 10) -> DataFrame:
    """Subcategories with the highest lift on the latest date of each festival over the window before it."""
    daily = materialize(_daily(sales, ["subcategory"]))
    # a row without a subcategory still marks the date of its festival
    dates = _first_days(daily).groupBy("festival").agg(F.max("festival_date").alias("festival_date"))
    if festival:
        dates = dates.where(F.col("festival") == festival)
    per_day = not_null(daily, ["subcategory"]).groupBy("order_date", "subcategory").agg(F.sum("revenue").alias("revenue"))
    d, f = F.col("order_date"), F.col("festival_date")
    out = _window_days(dates, before_days, 0).join(per_day, "order_date").groupBy("festival", "subcategory").agg(
        total(F.when(d < f, F.col("revenue"))).alias("before_sales"),
        total(F.when(d == f, F.col("revenue"))).alias("during_sales"))
    lift = (F.col("during_sales") - F.col("before_sales")) / (F.col("before_sales") + F.lit(1e-6)) * 100
    return top_n_per(out.withColumn("lift_pct", lift), n, "lift_pct", ["festival"], ["subcategory"])


# ---- competition inside each subcategory ----

_BRAND = ["subcategory", "brand"]


def _priced(sales: DataFrame) -> DataFrame:
    """Rows, revenue and units per (subcategory, brand, price), stored: the one scan that all results share."""
    require_columns(sales, ["brand", "subcategory", AMOUNT, "discounted_price_inr", "quantity"])
    rows = not_null(sales, [*_BRAND, "discounted_price_inr"])
    return materialize(rows.groupBy(*_BRAND, "discounted_price_inr").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(to_number0(AMOUNT)).alias(AMOUNT),
        F.sum(F.coalesce(F.col("quantity"), F.lit(0))).alias("quantity")))


def competing_brands(sales: DataFrame) -> DataFrame:
    """Revenue, volume, mean and median price and share of each brand in its subcategory."""
    rows = _priced(sales)
    sums = rows.groupBy(*_BRAND).agg(
        F.sum(AMOUNT).alias("revenue"), F.sum("quantity").alias("volume"),
        (F.sum(F.col("discounted_price_inr") * F.col("n_rows")) / F.sum("n_rows")).alias("avg_price"))
    medians = exact_quantiles(rows, "discounted_price_inr", [0.5], ["median_price"], _BRAND, weight="n_rows").drop("n")
    return sums.join(medians, _BRAND).withColumn("market_share", share_of("revenue", ["subcategory"]))


def _leaders(rows: DataFrame, n: int) -> DataFrame:
    return top_n_per(rows.groupBy(*_BRAND).agg(F.sum(AMOUNT).alias("revenue")), n, "revenue", ["subcategory"],
                     ["brand"]).select(*_BRAND)


def price_box(sales: DataFrame, n: int = 10) -> DataFrame:
    """Price summary of the leading brands of each subcategory; only their prices are ranked."""
    rows = _priced(sales)
    leading = rows.join(_leaders(rows, n), _BRAND, "left_semi")
    return box_summary(leading, "discounted_price_inr", _BRAND, weight="n_rows")


def price_tiers(sales: DataFrame, n: int = 10) -> DataFrame:
    """Revenue share of five price tiers for the leading brands of each subcategory.

    Tiers are the price quintiles of the subcategory, or fixed edges where quintiles coincide.
    """
    tiered = qcut(_priced(sales), "discounted_price_inr", fv.PRICE_TIERS, ["subcategory"], fv.PRICE_TIER_EDGES, "tier", weight="n_rows", digits=6)
    cols = ["tier_" + t.lower().replace(" ", "_") for t in fv.PRICE_TIERS]
    sums = tiered.groupBy("subcategory", "brand").agg(
        F.sum(AMOUNT).alias("revenue"),
        *[total(F.when(F.col("tier") == t, F.col(AMOUNT))).alias(c) for t, c in zip(fv.PRICE_TIERS, cols)])
    whole = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    best = top_n_per(sums, n, "revenue", ["subcategory"], ["brand"])
    return best.select("subcategory", "brand", *[
        F.coalesce(safe_div(c, whole) * 100, F.lit(0.0)).alias(c) for c in cols])
