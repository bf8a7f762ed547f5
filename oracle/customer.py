from oracle.common import corr_rows, cut, histogram_parts
from oracle.views import on_sales

_RFM = """rfm AS (SELECT customer_id, max(order_date) AS last_order, count(DISTINCT transaction_id) AS frequency,
  sum(final_amount_inr) AS monetary,
  CAST(date_diff('day', max(order_date), (SELECT max(order_date) FROM sales) + 1) AS INTEGER) AS recency_days
  FROM sales GROUP BY customer_id)"""
_RANKS = """ranks AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency_days, customer_id) AS rr,
  row_number() OVER (ORDER BY frequency, customer_id) AS fr, row_number() OVER (ORDER BY monetary, customer_id) AS mr FROM rfm)"""


def _score(rank: str) -> str:
    return f"CAST(CASE WHEN n = 1 THEN 3 ELSE greatest(1, (5 * ({rank} - 1) + n - 2) // (n - 1)) END AS INTEGER)"


_SCORES = f"""scores AS (SELECT *, 6 - {_score('rr')} AS r_score, {_score('fr')} AS f_score, {_score('mr')} AS m_score FROM ranks)"""
_FIRST = "firsts AS (SELECT customer_id, min(month_start) AS cohort_month FROM sales GROUP BY customer_id)"
_COHORT = """counts AS (SELECT cohort_month,
  CAST((year(month_start) - year(cohort_month)) * 12 + month(month_start) - month(cohort_month) AS INTEGER) AS months_since,
  count(DISTINCT customer_id) AS customers FROM sales JOIN firsts USING (customer_id) GROUP BY ALL),
  retention AS (SELECT *, max(CASE WHEN months_since = 0 THEN customers END) OVER (PARTITION BY cohort_month) AS cohort_size
  FROM counts)"""
_CLV = "clv AS (SELECT customer_id, sum(final_amount_inr) AS clv FROM sales GROUP BY customer_id)"
_AGES = """ages AS (SELECT unnest(['18-25', '26-35', '36-45', '46-55', '55+']) AS age_group)"""
_AGED = "aged AS (SELECT *, trim(customer_age_group) AS age_group FROM sales)"
_CELLS = """cells AS (SELECT age_group, subcategory, coalesce(sum(final_amount_inr), 0) AS rev
  FROM (SELECT DISTINCT subcategory FROM sales) CROSS JOIN ages LEFT JOIN aged USING (subcategory, age_group) GROUP BY ALL)"""
_AGE_ORD = "CAST(list_position(['18-25', '26-35', '36-45', '46-55', '55+'], age_group) - 1 AS INTEGER) AS ord"
_TIER_ORD = "CAST(list_position(['New', 'Occasional', 'Regular', 'Loyal'], loyalty_tier) - 1 AS INTEGER) AS ord"
_PURCHASES = "purchases AS (SELECT customer_id, count(DISTINCT transaction_id) AS purchases FROM sales GROUP BY customer_id)"
_RET = "lower(return_status) IN ('yes', 'true', 'returned', '1')"
_BANDS = ["<₹500", "₹500–₹1k", "₹1k–₹5k", "₹5k–₹10k", "₹10k–₹50k", ">₹50k"]
_EDGES = [0, 500, 1000, 5000, 10000, 50000, None]
_RATE = f"round(avg(CASE WHEN {_RET} THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS return_rate"

SQL = {
    "q_rfm_scores": on_sales(_RFM, _RANKS, _SCORES, """
SELECT customer_id, last_order, frequency, round(monetary, 6) AS monetary, recency_days, r_score, f_score, m_score,
  r_score + f_score + m_score AS rfm_score FROM scores"""),
    "q_rfm_segments": on_sales(_RFM, _RANKS, _SCORES, """
SELECT CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
  WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal' WHEN r_score = 5 AND f_score <= 2 THEN 'New'
  WHEN r_score <= 2 AND f_score >= 4 THEN 'At Risk'
  WHEN r_score <= 2 AND f_score <= 2 AND m_score <= 2 THEN 'Hibernating' ELSE 'Needs Attention' END AS segment,
  count(*) AS customers FROM scores GROUP BY segment"""),
    "q_cohort_retention": on_sales(_FIRST, _COHORT, """
SELECT cohort_month, months_since, customers, cohort_size, round(customers / cohort_size, 6) AS retention_rate FROM retention"""),
    "q_cohort_matrix": on_sales(_FIRST, _COHORT, """months AS (SELECT CAST(unnest(range(0, (SELECT max(months_since) + 1 FROM retention))) AS INTEGER)
  AS months_since)""", """
SELECT cohort_month, months_since, round(customers / cohort_size, 6) AS retention_rate
FROM (SELECT DISTINCT cohort_month FROM retention) CROSS JOIN months LEFT JOIN retention USING (cohort_month, months_since)"""),
    "q_clv_customer": on_sales(_CLV, "SELECT customer_id, round(clv, 6) AS clv FROM clv"),
    "q_clv_histogram": on_sales(_CLV, *histogram_parts("clv", "clv", 40, alias="customers", digits=2)),
    "q_clv_by_tier": on_sales(_CLV, """tiers AS (SELECT customer_id, arg_min(customer_tier, order_date) AS customer_tier
  FROM sales WHERE customer_tier IS NOT NULL GROUP BY customer_id)""", """
SELECT customer_tier, round(avg(clv), 2) AS avg_clv FROM clv JOIN tiers USING (customer_id) GROUP BY customer_tier"""),
    "q_clv_by_acq_year": on_sales("""acq AS (SELECT customer_id, CAST(year(min(order_date)) AS INTEGER) AS acquisition_year
  FROM sales GROUP BY customer_id)""", """
SELECT acquisition_year, round(sum(final_amount_inr), 2) AS total_clv FROM sales JOIN acq USING (customer_id)
GROUP BY acquisition_year"""),
    "q_age_spend": on_sales(_AGES, _AGED, f"""
SELECT age_group, {_AGE_ORD}, count(final_amount_inr) AS orders, round(avg(final_amount_inr), 6) AS avg_spend,
  round(coalesce(sum(final_amount_inr), 0), 2) AS total_spend FROM ages LEFT JOIN aged USING (age_group) GROUP BY age_group"""),
    "q_age_subcategory": on_sales(_AGES, _AGED, _CELLS, f"SELECT subcategory, age_group, {_AGE_ORD}, round(rev, 2) AS revenue FROM cells"),
    "q_age_rollup": on_sales(_AGES, _AGED, _CELLS, """
SELECT CASE grouping(age_group, subcategory) WHEN 0 THEN 'child' WHEN 1 THEN 'parent' ELSE 'all' END AS level,
  age_group, subcategory, round(sum(rev), 2) AS revenue FROM cells GROUP BY ROLLUP (age_group, subcategory)"""),
    "q_age_frequency": on_sales(_AGES, _AGED, f"""
SELECT order_year, age_group, {_AGE_ORD}, count(aged.transaction_id) AS order_count
FROM (SELECT DISTINCT order_year FROM sales) CROSS JOIN ages LEFT JOIN aged USING (order_year, age_group) GROUP BY ALL"""),
    "q_age_pivot": on_sales(_AGES, _AGED, _CELLS, "SELECT subcategory, " + ", ".join(
        f"round(coalesce(sum(CASE WHEN age_group = '{g}' THEN rev END), 0), 2) AS {a}" for g, a in [
            ("18-25", "age_18_25"), ("26-35", "age_26_35"), ("36-45", "age_36_45"), ("46-55", "age_46_55"),
            ("55+", "age_55_plus")]) + " FROM cells GROUP BY subcategory"),
    "q_purchase_freq": on_sales(_PURCHASES, "SELECT purchases, count(*) AS customer_count FROM purchases GROUP BY purchases"),
    "q_loyalty_tiers": on_sales(_PURCHASES, "tiers AS (SELECT unnest(['New', 'Occasional', 'Regular', 'Loyal']) AS loyalty_tier)",
        f"""counted AS (SELECT {cut('purchases', [0, 1, 3, 7, None], ['New', 'Occasional', 'Regular', 'Loyal'])} AS loyalty_tier
  FROM purchases)""", f"""
SELECT loyalty_tier, {_TIER_ORD}, count(counted.loyalty_tier) AS customer_count,
  round(count(counted.loyalty_tier) / sum(count(counted.loyalty_tier)) OVER () * 100, 6) AS share_pct
FROM tiers LEFT JOIN counted USING (loyalty_tier) GROUP BY loyalty_tier"""),
    "q_loyalty_evolution": on_sales("""y AS (SELECT order_year, customer_id, count(*) AS x FROM sales GROUP BY ALL),
  q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM y)""", """
SELECT order_year, CASE WHEN x <= q1 THEN 'New' WHEN x <= q2 THEN 'Occasional' WHEN x <= q3 THEN 'Regular' ELSE 'Loyal' END
  AS loyalty_tier, CASE WHEN x <= q1 THEN 0 WHEN x <= q2 THEN 1 WHEN x <= q3 THEN 2 ELSE 3 END AS ord, count(*) AS customer_count
FROM y, q GROUP BY ALL"""),
    "q_return_by_subcategory": on_sales(f"SELECT subcategory, {_RATE} FROM sales GROUP BY subcategory"),
    "q_return_by_price": on_sales(f"bands AS (SELECT unnest({_BANDS}) AS price_range)",
        f"banded AS (SELECT *, {cut('discounted_price_inr', _EDGES, _BANDS)} AS price_range FROM sales)", f"""
SELECT price_range, CAST(list_position({_BANDS}, price_range) - 1 AS INTEGER) AS ord, round(avg(CASE WHEN {_RET} THEN 1.0::DOUBLE WHEN transaction_id IS NOT NULL THEN 0 END) * 100, 6) AS return_rate
FROM bands LEFT JOIN banded USING (price_range) GROUP BY price_range"""),
    "q_return_corr": on_sales(f"flagged AS (SELECT *, CASE WHEN {_RET} THEN 1 ELSE 0 END AS is_returned FROM sales)",
        corr_rows(["is_returned", "customer_rating", "discount_percent", "discounted_price_inr", "final_amount_inr"], "flagged")),
    "q_return_by_rating": on_sales(f"""
SELECT customer_rating, {_RATE} FROM sales WHERE customer_rating IS NOT NULL GROUP BY customer_rating"""),
}
