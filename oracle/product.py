from oracle.common import corr_rows, corr, histogram_parts, regr
from oracle.views import on_sales

_CATS = "cats AS (SELECT order_year, subcategory, sum(final_amount_inr) AS rev FROM sales GROUP BY ALL)"
_GROWTH = """growth AS (SELECT *, (rev / nullif(lag(rev) OVER (PARTITION BY subcategory ORDER BY order_year), 0) - 1) * 100 AS g
  FROM cats)"""
_BRANDS = "by_brand AS (SELECT order_year, brand, sum(final_amount_inr) AS rev, count(*) AS n FROM sales GROUP BY ALL)"
_TOP = "top AS (SELECT brand FROM by_brand GROUP BY brand ORDER BY sum(rev) DESC, brand LIMIT 10)"
_MONTHLY = """monthly AS (SELECT product_id, month_start AS order_month, sum(final_amount_inr) AS rev,
    CAST(sum(quantity) AS BIGINT) AS qty FROM sales GROUP BY ALL),
  launch AS (SELECT product_id, min(order_date) AS launch_date, arg_min(product_name, order_date) AS product_name,
    arg_min(subcategory, order_date) AS subcategory FROM sales GROUP BY product_id),
  pm AS (SELECT * FROM monthly JOIN launch USING (product_id))"""
_LIFE = """peaks AS (SELECT product_id, order_month AS peak_month, rev AS peak_revenue FROM monthly
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY rev DESC, order_month) = 1),
  totals AS (SELECT product_id, any_value(product_name) AS product_name, any_value(subcategory) AS subcategory,
    any_value(launch_date) AS launch_date, sum(rev) AS total_revenue,
    coalesce(sum(CASE WHEN floor(date_diff('day', launch_date, order_month) / 30) BETWEEN 0 AND 3 THEN rev END), 0) AS first90
    FROM pm GROUP BY product_id),
  life AS (SELECT *, CAST(floor(date_diff('day', launch_date, peak_month) / 30) AS INTEGER) AS ttp
    FROM totals JOIN peaks USING (product_id))"""

SQL = {
    "q_cat_revenue": on_sales("""
SELECT subcategory, round(sum(final_amount_inr), 2) AS revenue,
  round(sum(final_amount_inr) / sum(sum(final_amount_inr)) OVER () * 100, 6) AS share_pct,
  round(sum(final_amount_inr * final_amount_inr) / sum(final_amount_inr), 2) AS weighted_amount FROM sales GROUP BY subcategory"""),
    "q_cat_yearly_growth": on_sales(_CATS, _GROWTH, """
SELECT order_year, subcategory, round(rev, 2) AS revenue, round(g, 6) AS growth_pct FROM growth"""),
    "q_cat_avg_growth": on_sales(_CATS, _GROWTH, """
SELECT subcategory, round(coalesce(avg(g), 0), 6) AS avg_growth_pct FROM growth GROUP BY subcategory"""),
    "q_brand_year_top10": on_sales(_BRANDS, _TOP, """
SELECT order_year, brand, round(rev, 2) AS revenue FROM by_brand WHERE brand IN (SELECT brand FROM top)"""),
    "q_brand_share": on_sales(_BRANDS, _TOP, """shares AS (SELECT s.order_year, s.brand,
  s.final_amount_inr / sum(s.final_amount_inr) OVER (PARTITION BY s.order_year) * 100 AS share FROM sales s)""", """
SELECT order_year, brand, round(avg(share), 6) AS mean_row_share, round(sum(share), 6) AS market_share
FROM shares WHERE brand IN (SELECT brand FROM top) GROUP BY order_year, brand"""),
    "q_brand_top_in_category": on_sales("""
SELECT subcategory, brand, round(sum(final_amount_inr), 2) AS revenue,
  CAST(row_number() OVER (PARTITION BY subcategory ORDER BY sum(final_amount_inr) DESC, brand) AS INTEGER) AS rank
FROM sales GROUP BY subcategory, brand QUALIFY rank <= 10"""),
    "q_brand_rollup": on_sales("""
SELECT CASE grouping(subcategory, brand) WHEN 0 THEN 'child' WHEN 1 THEN 'parent' ELSE 'all' END AS level,
  subcategory, brand, round(sum(final_amount_inr), 2) AS revenue,
  round(sum(final_amount_inr * final_amount_inr) / sum(final_amount_inr), 2) AS weighted_amount
FROM sales GROUP BY ROLLUP (subcategory, brand)"""),
    "q_prod_monthly": on_sales(_MONTHLY, """
SELECT product_id, order_month, round(rev, 6) AS monthly_revenue, qty AS monthly_qty, product_name, subcategory, launch_date FROM pm"""),
    "q_prod_lifecycle": on_sales(_MONTHLY, _LIFE, """
SELECT product_id, product_name, subcategory, launch_date, peak_month, round(peak_revenue, 6) AS peak_revenue,
  round(total_revenue, 6) AS total_revenue, round(first90, 6) AS rev_first_90days, ttp AS time_to_peak_months FROM life"""),
    "q_prod_launches_per_year": on_sales(_MONTHLY, """
SELECT CAST(year(launch_date) AS INTEGER) AS launch_year, count(*) AS launch_count FROM launch GROUP BY launch_year"""),
    "q_prod_ttp_hist": on_sales(_MONTHLY, _LIFE, *histogram_parts("life", "ttp", 24, alias="products")),
    "q_prod_curve": on_sales(_MONTHLY, """pick AS (SELECT product_id FROM launch WHERE product_name IS NOT NULL
  ORDER BY product_name, product_id LIMIT 1)""", """
SELECT product_id, product_name, order_month, round(rev, 6) AS monthly_revenue, qty AS monthly_qty
FROM pm WHERE product_id = (SELECT product_id FROM pick)"""),
    "q_prod_top_launches": on_sales(_MONTHLY, _LIFE, """
SELECT product_id, product_name, round(first90, 6) AS rev_first_90days FROM life ORDER BY first90 DESC, product_id LIMIT 15"""),
    "q_price_ols": on_sales(f"""
SELECT subcategory, brand, {regr('quantity', 'discounted_price_inr')} FROM sales WHERE quantity > 0 GROUP BY subcategory, brand"""),
    "q_price_corr": on_sales("sold AS (SELECT * FROM sales WHERE quantity > 0)", corr_rows(
        ["original_price_inr", "discount_percent", "discounted_price_inr", "quantity", "final_amount_inr"], "sold", "subcategory")),
    "q_price_elasticity": on_sales(f"""
SELECT subcategory, {corr('discounted_price_inr', 'quantity')} AS price_demand_corr FROM sales WHERE quantity > 0 GROUP BY subcategory"""),
}
