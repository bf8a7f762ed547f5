from oracle.common import box, corr, histogram_parts, regr
from oracle.views import on_sales

_PAY = """pay AS (SELECT order_year, payment_method, sum(final_amount_inr) AS rev FROM sales GROUP BY ALL),
  shares AS (SELECT *, rev / sum(rev) OVER (PARTITION BY order_year) * 100 AS share FROM pay)"""
_DELIVERED = "delivered AS (SELECT * FROM sales WHERE delivery_days >= 0)"
_ON_TIME = "round(avg(CASE WHEN delivery_days <= 3 THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS on_time_pct"
_TYPE = "CASE WHEN is_prime_member THEN 'Prime' ELSE 'Non-Prime' END AS member_type"

SQL = {
    "q_pay_share": on_sales(_PAY, "SELECT order_year, payment_method, round(rev, 2) AS revenue, round(share, 6) AS share_pct FROM shares"),
    "q_pay_top_latest": on_sales(_PAY, """
SELECT order_year, payment_method, round(share, 6) AS share_pct FROM shares ORDER BY order_year DESC, share DESC, payment_method LIMIT 1"""),
    "q_deliv_hist": on_sales(_DELIVERED, *histogram_parts("delivered", "delivery_days", 20, "customer_tier", "orders")),
    "q_deliv_box": on_sales(_DELIVERED, f"""
SELECT customer_tier, {box('delivery_days')}, count(*) AS n FROM delivered GROUP BY customer_tier"""),
    "q_deliv_on_time": on_sales(_DELIVERED, f"""
SELECT customer_city, customer_tier, {_ON_TIME} FROM delivered GROUP BY customer_city, customer_tier"""),
    "q_deliv_rating_corr": on_sales(_DELIVERED, f"""
SELECT {corr('delivery_days', 'customer_rating')} AS corr,
  CASE WHEN corr(delivery_days, customer_rating) < 0 THEN 'negative' ELSE 'weak or positive' END AS verdict FROM delivered"""),
    "q_deliv_rating_ols": on_sales(_DELIVERED, f"""
SELECT customer_tier, {regr('customer_rating', 'delivery_days')} FROM delivered GROUP BY customer_tier"""),
    "q_deliv_tier": on_sales(_DELIVERED, f"""
SELECT customer_tier, round(avg(delivery_days), 6) AS avg_delivery_days, {_ON_TIME},
  round(avg(customer_rating), 6) AS avg_rating FROM delivered GROUP BY customer_tier"""),
    "q_prime_summary": on_sales(f"""
SELECT {_TYPE}, count(DISTINCT transaction_id) AS orders, count(DISTINCT customer_id) AS customers,
  round(sum(final_amount_inr), 2) AS revenue, count(order_date) AS dated_rows, round(avg(final_amount_inr), 6) AS avg_order_value,
  round(count(DISTINCT transaction_id) / count(DISTINCT customer_id), 6) AS orders_per_customer FROM sales GROUP BY is_prime_member"""),
    "q_prime_freq_box": on_sales(f"""per AS (SELECT customer_id, {_TYPE}, count(transaction_id) AS c FROM sales GROUP BY ALL)""", f"""
SELECT member_type, {box('c')}, count(*) AS n FROM per GROUP BY member_type"""),
    "q_prime_subcategory": on_sales(f"""
SELECT {_TYPE}, subcategory, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY ALL"""),
    "q_prime_share": on_sales(f"""
SELECT {_TYPE}, round(sum(final_amount_inr), 2) AS revenue,
  round(sum(final_amount_inr) / sum(sum(final_amount_inr)) OVER () * 100, 6) AS share_pct FROM sales GROUP BY is_prime_member"""),
}
