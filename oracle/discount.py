from oracle.common import corr_rows, regr
from oracle.views import on_sales

_MONTHS = "months AS (SELECT unnest(range(1, 13))::INTEGER AS order_month)"
_YEARS = "years AS (SELECT DISTINCT order_year FROM sales)"
_UNITS = "units AS (SELECT subcategory, CAST(sum(quantity) AS BIGINT) AS total_units FROM sales GROUP BY subcategory)"

SQL = {
    "q_disc_ols": on_sales(f"""
SELECT subcategory, {regr('quantity', 'discount_percent')} FROM sales GROUP BY subcategory"""),
    "q_disc_subcategory": on_sales("""
SELECT subcategory, round(avg(discount_percent), 6) AS avg_discount, CAST(sum(quantity) AS BIGINT) AS total_units,
  round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY subcategory"""),
    "q_disc_best_worst": on_sales(_UNITS, """
(SELECT 'best' AS kind, subcategory, total_units FROM units ORDER BY total_units DESC, subcategory LIMIT 1)
UNION ALL (SELECT 'worst', subcategory, total_units FROM units ORDER BY total_units, subcategory LIMIT 1)"""),
    "q_disc_monthly": on_sales(_MONTHS, _YEARS, """
SELECT order_year, order_month, monthname(make_date(2000, order_month, 1)) AS order_month_name,
  round(avg(discount_percent), 6) AS avg_discount, round(coalesce(sum(final_amount_inr), 0), 2) AS revenue
FROM years CROSS JOIN months LEFT JOIN sales USING (order_year, order_month) GROUP BY order_year, order_month"""),
    "q_disc_corr": on_sales(corr_rows(["discount_percent", "quantity", "final_amount_inr"], "sales")),
    "q_disc_effectiveness": on_sales("""
SELECT subcategory, round(avg(quantity * discount_percent / nullif(final_amount_inr, 0)), 6) AS discount_effectiveness
FROM sales GROUP BY subcategory"""),
}
