from oracle.views import on_sales

_YEARLY = """yearly AS (SELECT order_year, sum(final_amount_inr) AS rev FROM sales
  WHERE order_year IS NOT NULL GROUP BY order_year)"""
_YOY = """yoy AS (SELECT order_year, rev, (rev / nullif(lag(rev) OVER (ORDER BY order_year), 0) - 1) * 100 AS pct
  FROM yearly)"""
_MONTHS = """months AS (SELECT unnest(range(1, 13))::INTEGER AS order_month)"""
_MONTH_NAME = "monthname(make_date(2000, order_month, 1))"

SQL = {
    "q_rev_yearly": on_sales(_YEARLY, _YOY, """
SELECT order_year, round(rev, 2) AS revenue_inr, round(pct, 6) AS yoy_pct FROM yoy"""),
    "q_rev_cagr": on_sales(_YEARLY, """
SELECT min(order_year) AS start_year, max(order_year) AS end_year,
  round(arg_min(rev, order_year), 2) AS start_revenue, round(arg_max(rev, order_year), 2) AS end_revenue,
  round((pow(arg_max(rev, order_year) / arg_min(rev, order_year),
    1.0 / greatest(1, max(order_year) - min(order_year))) - 1) * 100, 6) AS cagr_pct FROM yearly"""),
    "q_rev_trend": on_sales(_YEARLY, """
SELECT order_year, round(rev, 2) AS revenue_inr,
  round((SELECT regr_slope(rev, order_year) FROM yearly) * order_year
    + (SELECT regr_intercept(rev, order_year) FROM yearly), 2) AS trend_inr FROM yearly"""),
    "q_rev_best_worst": on_sales(_YEARLY, _YOY, """
(SELECT 'best' AS kind, order_year, round(rev, 2) AS revenue_inr, round(pct, 6) AS yoy_pct FROM yoy
 WHERE pct IS NOT NULL ORDER BY pct DESC, order_year LIMIT 1)
UNION ALL
(SELECT 'worst', order_year, round(rev, 2), round(pct, 6) FROM yoy WHERE pct IS NOT NULL ORDER BY pct, order_year LIMIT 1)"""),
    "q_rev_month_grid": on_sales("""
SELECT order_year, order_month, round(sum(final_amount_inr), 2) AS revenue, order_month_name FROM sales
GROUP BY order_year, order_month, order_month_name"""),
    "q_rev_peak_months": on_sales(_MONTHS, f"""
SELECT order_month, {_MONTH_NAME} AS order_month_name, round(sum(final_amount_inr), 2) AS revenue
FROM months LEFT JOIN sales USING (order_month) GROUP BY order_month"""),
    "q_rev_top_month": on_sales("""
SELECT order_month_name, round(sum(final_amount_inr), 2) AS revenue FROM sales
GROUP BY order_month_name, order_month ORDER BY sum(final_amount_inr) DESC, order_month LIMIT 1"""),
    "q_health_kpis": on_sales("""
SELECT round(sum(final_amount_inr), 2) AS total_revenue, count(DISTINCT customer_id) AS customers,
  count(DISTINCT transaction_id) AS orders FROM sales"""),
    "q_health_yearly": on_sales("""
SELECT order_year, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY order_year"""),
    "q_health_new_customers": on_sales("""firsts AS (SELECT customer_id, min(month_start) AS month FROM sales GROUP BY customer_id)""", """
SELECT month, count(*) AS new_customers FROM firsts GROUP BY month"""),
    "q_health_repeat_rate": on_sales("""per AS (SELECT customer_id, count(DISTINCT transaction_id) AS n FROM sales GROUP BY customer_id)""", """
SELECT round(avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS repeat_rate_pct FROM per"""),
    "q_health_delivery": on_sales("""
SELECT month_start AS month, round(avg(delivery_days), 6) AS avg_delivery_days FROM sales GROUP BY month_start"""),
    "q_health_returns": on_sales("""
SELECT month_start AS month, round(avg(CASE WHEN return_status = 'Returned' THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS return_rate_pct
FROM sales GROUP BY month_start"""),
}
